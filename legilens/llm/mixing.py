"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells (source, language, topic) of token weight. Each sweep sets the factors of one margin so
that its weighted sums meet the targets, margin after margin; factors and cells are small tables, summed with partial aggregation,
so a source with a third of all rows costs no more than another. The fitted weight of a cell over its tokens gives the inclusion
probability of its documents; a hash of the identifier draws them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legilens.llm.shared import free, saved

MARGINS = ("source", "lang", "topic")
#: Default targets: each margin's shares raised to this power and scaled to one, so that large classes shrink.
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.5}
#: Sweeps over the three margins.
SWEEPS = 6
#: Share of all tokens that the sample should have.
BUDGET = 0.5
SEED = 17

WORDS = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words in a text: maximal runs without ASCII white space. Null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the text's form: table, shouting, brief, article or long."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 5, "table")
        .when((F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) * 4 >= tokens, "shouting")
        .when(tokens < 100, "brief")
        .when(tokens < 1000, "article")
        .otherwise("long")
    )


def cells_of(weighted: DataFrame) -> DataFrame:
    """(source, lang, topic, mass, share_*): token weight per cell that has any."""
    return weighted.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("mass")).filter("mass > 0")


def targets_of(cells: DataFrame, margin: str, given: Mapping[str, float] | None, budget: float) -> DataFrame:
    """(margin, target, lift): the given shares, or the tempered ones, as far as the classes' tokens reach, scaled to one over the classes that occur.

    A class that has fewer tokens than its share of the budget gives all of them, and the others share what it lacks in proportion. lift is
    the share asked for over the target. The order by need is over one row for each class of a margin.
    """
    sums = cells.groupBy(margin).agg(F.sum("mass").alias("mass"))
    if given is None:
        shares = sums.select(margin, "mass", F.pow("mass", F.lit(TEMPER[margin])).alias("share"))
    else:
        table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        shares = sums.select(margin, "mass", F.coalesce(F.element_at(table, F.col(margin)), F.lit(0.0)).alias("share"))
    whole = shares.agg(F.sum("share").alias("all_shares"), F.sum("mass").alias("all_mass"))  # one row
    asked = shares.join(F.broadcast(whole)).select(
        margin, (F.col("share") / F.col("all_shares")).alias("asked"), (F.col("mass") / (F.lit(budget) * F.col("all_mass"))).alias("cap")
    )
    order = Window.orderBy(F.when(F.col("asked") > 0, F.col("cap") / F.col("asked")).asc_nulls_last(), margin)
    done = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("asked").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = asked.withColumns({"done": done, "rest": rest}).withColumn("level", F.when(F.col("rest") > 0, (1 - F.col("done")) / F.col("rest")))
    level = levels.filter("level * asked <= cap").agg(F.coalesce(F.max("level"), F.lit(1e300)).alias("level"))  # one row
    target = F.least("cap", F.col("asked") * F.col("level"))
    return asked.join(F.broadcast(level)).select(margin, target.alias("target"), F.when(target > 0, F.col("asked") / target).otherwise(0.0).alias(f"lift_{margin}"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """The cells with their fitted share and lift. In the later half of the sweeps a cell counts for no more than its tokens, so that the others of its
    classes make up for it; a cell whose fitted share is over that gives all it has."""
    aims = {m: saved(targets_of(cells, m, (targets or {}).get(m), budget), f"target-{m}") for m in MARGINS}
    factors = {m: aims[m].select(m, F.lit(1.0).alias(f"f_{m}")) for m in MARGINS}
    whole = cells.agg(F.sum("mass").alias("whole"))  # one row
    roomy = cells.join(F.broadcast(whole)).select(*MARGINS, "mass", (F.col("mass") / (F.lit(budget) * F.col("whole"))).alias("room"))
    fitted = F.expr("mass * " + " * ".join(f"f_{m}" for m in MARGINS))
    for k in range(sweeps):
        counted = F.least(fitted, F.col("room")) if k >= sweeps // 2 else fitted
        for m in MARGINS:
            rows = roomy
            for margin in MARGINS:
                rows = rows.join(factors[margin], margin)
            now = rows.groupBy(m).agg(F.sum(counted).alias("now"))
            factor = F.when(F.col("now") > 0, F.col(f"f_{m}") * F.col("target") / F.col("now")).otherwise(0.0)
            after = now.join(aims[m], m).join(factors[m], m).select(m, factor.alias(f"f_{m}"))
            factors[m] = saved(after.coalesce(1), f"factor-{m}")  # a row for each class of one margin
    out = cells
    for m in MARGINS:
        out = out.join(factors[m], m).join(aims[m].drop("target"), m)
    return out.select(*MARGINS, "mass", fitted.alias("fitted"), F.expr(" * ".join(f"lift_{m}" for m in MARGINS)).alias("lift"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    seed: int = SEED,
    sweeps: int = SWEEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, probability, weight, selected.

    probability is min(1, wanted tokens of the cell / its tokens), where the wanted tokens are the fitted share of budget
    times all tokens; targets that the tokens of a class don't reach are lowered to what it has (targets_of). weight is the shares asked for of the
    document's source, language and topic over these, multiplied: 1 unless a target was lowered or another raised for it. Documents without words carry no weight and are never selected. Null source and lang are the class "".
    Rows with the same identifier are drawn alike; a null identifier is drawn as the empty string. Other columns are ignored.
    """
    columns = _judged(docs, text_col)
    weighted = saved(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(name) for name, c in columns.items()]), "weighted")
    ratio = ratios(weighted, targets, budget, sweeps)
    probability = _probability(F.col("tokens"), F.col("ratio"))
    return (
        weighted.join(ratio, list(MARGINS), "left")
        .withColumn("probability", probability)
        .select(
            "doc_id", *MARGINS, "tokens",
            F.round("probability", 9).alias("probability"),
            F.round(F.when(F.col("probability") > 0, F.col("lift")).otherwise(0.0), 9).alias("weight"),
            (_draw(F.col("doc_id"), seed) < F.col("probability")).alias("selected"),
        )
    )


def _judged(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """What a row is weighed by: source, lang, tokens and topic."""
    text, blank = F.col(f"`{text_col}`"), F.lit("")
    tokens = tokens_of(text)
    return {"source": F.coalesce(F.col("source"), blank), "lang": F.coalesce(F.col("lang"), blank), "tokens": tokens, "topic": topic_of(text, tokens)}


def _probability(tokens: Column, ratio: Column) -> Column:
    return F.when(tokens > 0, F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)))).otherwise(0.0)


def _draw(ident: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the identifier only."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def ratios(weighted: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, budget: float, sweeps: int) -> DataFrame:
    """(source, lang, topic, ratio, lift): wanted tokens of each cell over its tokens, and the shares asked for over those aimed at."""
    cells = saved(cells_of(weighted), "cells")
    whole = cells.agg(F.sum("mass").alias("whole"))  # one row
    ratio = (F.lit(budget) * F.col("whole") * F.col("fitted") / F.col("mass")).alias("ratio")
    return rake(cells, targets, sweeps, budget).join(F.broadcast(whole)).select(*MARGINS, ratio, "lift")


def keep_selected(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = SEED, sweeps: int = SWEEPS
) -> DataFrame:
    """The selected rows of docs, with all their columns. Each row is judged by its own columns, as mix() does.

    Rows that share a doc_id are drawn alike but weighed each; a null doc_id is drawn as the empty text. Rows without words are never
    selected. An empty table stays empty.
    """
    columns = _judged(docs, "text")
    ratio = saved(ratios(docs.select(*[c.alias(name) for name, c in columns.items()]), targets, budget, sweeps), "ratios")
    whole = free("whole_row", docs)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col("doc_id").alias("_id"), *[c.alias(name) for name, c in columns.items()])
    chosen = judged.join(ratio, list(MARGINS)).filter(_draw(F.col("_id"), seed) < _probability(F.col("tokens"), F.col("ratio")))
    return chosen.select(f"{whole}.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    parts = [
        rf"""w as materialized (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t,
         len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as tokens from documents
), d as materialized (
  select doc_id, source, lang, tokens,
         case when length(t) - length(replace(t, '|', '')) >= 5 then 'table'
              when (length(t) - length(replace(t, '!', ''))) * 4 >= tokens then 'shouting'
              when tokens < 100 then 'brief' when tokens < 1000 then 'article' else 'long' end as topic from w
), c as materialized (
  select source, lang, topic, sum(tokens)::double as mass from d group by all having sum(tokens) > 0
)"""
    ]
    parts.append(f"cells as materialized (select *, mass / ({BUDGET} * (select sum(mass) from c)) as room from c)")
    last = {}
    for m in MARGINS:
        parts.append(f"s_{m} as (select {m}, sum(mass) as mass, pow(sum(mass), {TEMPER[m]}) as share from c group by {m})")
        parts.append(
            f"a_{m} as materialized (select {m}, share / (select sum(share) from s_{m}) as asked, mass / ({BUDGET} * (select sum(mass) from s_{m})) as cap from s_{m})"
        )
        parts.append(
            f"l_{m} as (select *, (1 - coalesce(sum(cap) over (order by cap / asked, {m} rows between unbounded preceding and 1 preceding), 0))"
            f" / sum(asked) over (order by cap / asked, {m} rows between current row and unbounded following) as level from a_{m})"
        )
        parts.append(
            f"t_{m} as materialized (select {m}, target, asked / target as lift_{m}, 1.0::double as f_{m} from (select *, least(cap, asked"
            f" * coalesce((select max(level) from l_{m} where level * asked <= cap), 1e300)) as target from a_{m}))"
        )
        last[m] = f"t_{m}"
    fitted = "mass * " + " * ".join(f"f_{m}" for m in MARGINS)
    for k in range(SWEEPS):
        counted = f"least({fitted}, room)" if k >= SWEEPS // 2 else fitted
        for m in MARGINS:
            joins = " ".join(f"join (select {o}, f_{o} from {last[o]}) using ({o})" for o in MARGINS)
            parts.append(
                f"f{k}_{m} as materialized (select n.{m}, b.f_{m} * t.target / n.now as f_{m} from (select {m}, sum({counted}) as now"
                f" from cells {joins} group by {m}) n join t_{m} t on n.{m} = t.{m} join {last[m]} b on n.{m} = b.{m})"
            )
            last[m] = f"f{k}_{m}"
    joins = " ".join(f"join (select {m}, f_{m} from {last[m]}) using ({m}) join (select {m}, lift_{m} from t_{m}) using ({m})" for m in MARGINS)
    lift = " * ".join(f"lift_{m}" for m in MARGINS)
    parts.append(f"r as materialized (select source, lang, topic, {BUDGET} * (select sum(mass) from c) * ({fitted}) / mass as ratio, {lift} as lift from c {joins})")
    parts.append(
        "p as (select d.*, lift, case when tokens > 0 then least(1.0, coalesce(ratio, 0.0)) else 0.0 end as probability"
        " from d left join r using (source, lang, topic))"
    )
    return (
        "with " + ",\n".join(parts) + "\nselect doc_id, source, lang, topic, tokens, round(probability, 9) as probability,"
        " round(case when probability > 0 then lift else 0.0 end, 9) as weight,"
        f" ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/{SEED}'), 1, 12))::bigint::double / {float(1 << 48)} < probability as selected from p"
    )


SQL = _sql()
