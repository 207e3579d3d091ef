"""Obfuscated words in long runs, stretched words and words of look-alikes alone."""

import numpy as np
from legilens.llm import toxicity


def test_long_runs_and_signs_alone():
    model = np.full((toxicity.LETTERS,) * 3, -np.log(toxicity.LETTERS))
    scorer = toxicity.Scorer(model, {"idiot": 9.0, "stupid*": 9.0, "scum": 9.0, "ass": 9.0}, -3.0, -6.0)
    toxic = [
        " ".join("youareallsoverywelcomehereidiot"), "sc" + "u" * 60 + "m", "st" + "u" * 60 + "pidity", "you are a i d i o t", "y o u i d i o t",
        " ".join("youstupidpeople"), "what an @$$ it is", "such @$$",
    ]
    clean = ["it costs $50 or 100€ and 5 + 5 = 10", "$$$ 1,000 (5) 2*3", "h e r e " + "x" * 60, "so" + "o" * 80, "y o u a r e n i c e"]
    assert [scorer.score(t) >= 0.5 for t in toxic] == [True] * len(toxic)
    assert [scorer.score(t) >= 0.5 for t in clean] == [False] * len(clean)
