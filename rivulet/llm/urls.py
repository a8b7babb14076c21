"""URL filter: host and path rules, and for the rest the likelihood ratio of two character models.

Only DataFrame functions are used. Both models are one table of four-character
sequences over a reduced alphabet, at most ALPHABET ** 4 rows whatever the number
of pages; that is the proven bound of the one broadcast below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import own_name
from rivulet.plans.fixpoint import cut

#: (host, path, verdict); fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Letters, a run of digits, dot, dash, slash, any other character, and the mark before the start.
ALPHABET = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as (rule, verdict), null if none does; of equally long ones the first in code-point order."""
    best: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.coalesce(best, F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return best


def normal_form(url: Column) -> Column:
    """The URL in the models' alphabet: lower case, a run of digits as 0, any other character as `~`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]+", "0"), r"[^a-z0.\-/]", "~")


def grams(form: Column) -> Column:
    """Every character with the three before it, `^` standing before the start."""
    chars = F.split(F.concat(F.lit("^^^"), form), "")
    at = lambda i, k: F.element_at(chars, (i + k).cast("int"))
    ends = F.when(F.length(form) > 0, F.sequence(F.lit(1), F.length(form))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.concat(at(i, 0), at(i, 1), at(i, 2), at(i, 3)))


def gram_ratios(counts: DataFrame) -> DataFrame:
    """Log-likelihood ratio (accepted to rejected) of each four-character sequence.

    `counts` has (gram, accepted, rejected), with zeros for sequences that only
    URLs to judge contain. Each model backs off from three characters of context
    to none and then to the uniform distribution (Witten-Bell smoothing): a context
    seen N times before T different characters gives its own counts the weight N / (N + T).
    """
    sides = ("accepted", "rejected")
    out = counts.select("gram", F.substring("gram", 4, 1).alias("c0"), *[F.substring("gram", 5 - k, k).alias(f"c{k}") for k in (2, 3)], F.substring("gram", 1, 3).alias("x3"), F.substring("gram", 2, 2).alias("x2"), F.substring("gram", 3, 1).alias("x1"), *sides)
    level = {3: ("gram", "x3"), 2: ("c3", "x2"), 1: ("c2", "x1")}
    total = out.groupBy("c0").agg(*[F.sum(s).alias(f"{s}_n0") for s in sides])
    whole = total.agg(*[F.sum(f"{s}_n0").alias(f"{s}_all0") for s in sides], *[F.count(F.when(F.col(f"{s}_n0") > 0, 1)).alias(f"{s}_kinds0") for s in sides])
    once = whole.select(F.struct("*").alias("w")).scalar()
    p = {}
    out = out.join(total, "c0").withColumn("w", once)
    for s in sides:
        n, of, kinds = F.col(f"{s}_n0"), F.col("w")[f"{s}_all0"], F.col("w")[f"{s}_kinds0"]
        p[s] = F.when(of > 0, (n + kinds / ALPHABET) / (of + kinds)).otherwise(F.lit(1.0 / ALPHABET))
    out = out.select(*[c for c in out.columns if c not in ("w",) and not c.endswith("_n0")], *[p[s].alias(f"{s}_p") for s in sides])
    for k in (1, 2, 3):
        seq, ctx = level[k]
        own = out.groupBy(seq, ctx).agg(*[F.sum(s).alias(f"{s}_n") for s in sides])
        per = own.groupBy(ctx).agg(*[F.sum(f"{s}_n").alias(f"{s}_all") for s in sides], *[F.count(F.when(F.col(f"{s}_n") > 0, 1)).alias(f"{s}_kinds") for s in sides])
        out = out.join(own.drop(ctx), seq).join(per, ctx)
        better = [F.when(F.col(f"{s}_all") > 0, (F.col(f"{s}_n") + F.col(f"{s}_kinds") * F.col(f"{s}_p")) / (F.col(f"{s}_all") + F.col(f"{s}_kinds"))).otherwise(F.col(f"{s}_p")).alias(f"{s}_p") for s in sides]
        keep = [c for c in ("gram", "c2", "c3", "x1", "x2", "x3", *sides) if c in out.columns]
        out = cut(out.select(*keep, *better))  # keeps the plan of the next level short
    return out.select("gram", (F.ln("accepted_p") - F.ln("rejected_p")).alias("ratio"))


def calibrated_threshold(scores: DataFrame, step: float = 0.01) -> Column:
    """The score that best separates held-out rows, as a scalar: highest balanced accuracy, then nearest to 0.

    `scores` has (score, accepted, rejected) with row counts. Scores are counted in
    bins of `step`; without rows of both kinds the threshold is 0.
    """
    bins = scores.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row per bin: a few thousand at most
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = bins.select("bin", F.coalesce(F.sum("a").over(upto), F.lit(0)).alias("a_below"), F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("r_below"), F.sum("a").over(every).alias("all_a"), F.sum("r").over(every).alias("all_r"))
    cuts = cuts.where("all_a > 0 and all_r > 0").select("bin", ((F.col("all_a") - F.col("a_below")) / F.col("all_a") + F.col("r_below") / F.col("all_r")).alias("right"))
    return F.coalesce(cuts.agg(F.max_by(F.col("bin") * step, F.struct(F.col("right"), -F.abs("bin")))).scalar(), F.lit(0.0))


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, holdout: int = 5) -> DataFrame:
    """Add host, path, rule, url_score and verdict to every page, keeping its other columns.

    URLs that a rule decides are the accepted and rejected examples. The models
    learn from the normal forms whose CRC-32 is not divisible by `holdout`; the others set the
    threshold on the score, the mean log ratio per character. A URL at or above the threshold is
    allowed; so is one of no characters (score 0 then). Null URLs have an
    empty host and path and are judged as empty. Columns of the result replace columns of the same name, whatever its case;
    any other name may stand in the table. Repeated rows stay and count as often as they occur; an empty table gives no rows. A URL of any length is
    read whole.
    """
    form, model, score = own_name(pages, "form__"), own_name(pages, "by_model__"), "url_score"
    u = F.col(url)
    results = ("host", "path", "rule", "verdict", score)
    if url.lower() in results:
        raise ValueError(f"the column of URLs has the name of a result: {url}")
    rows = pages.select(*[c for c in pages.columns if c.lower() not in results], normal_form(u).alias(form), host_of(u).alias("host"), path_of(u).alias("path"))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", hit["rule"]).withColumn("verdict", hit["verdict"])
    said = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    forms = cut(rows.groupBy(form).agg(said("allow").alias("accepted"), said("block").alias("rejected")).withColumnRenamed(form, "form"))
    held = F.crc32("form") % holdout == 0
    learn = lambda c: F.sum(F.when(held, 0).otherwise(F.col(c))).alias(c)
    spread = forms.select("form", "accepted", "rejected", F.explode(grams(F.col("form"))).alias("gram"))
    ratios = cut(gram_ratios(cut(spread.groupBy("gram").agg(learn("accepted"), learn("rejected")))))
    # at most ALPHABET ** 4 rows of 40 bytes: bounded whatever the input
    scored = spread.join(F.broadcast(ratios), "gram").groupBy("form").agg(F.avg("ratio").alias(score))
    scored = cut(forms.join(scored, "form", "left").withColumn(score, F.coalesce(score, F.lit(0.0))))
    threshold = calibrated_threshold(scored.where(F.crc32("form") % holdout == 0).select(F.col(score).alias("score"), "accepted", "rejected"))
    scored = scored.select(F.col("form").alias(form), score, F.when(F.col(score) >= threshold, "allow").otherwise("block").alias(model))
    out = rows.join(scored, form, "left")
    return out.withColumn("verdict", F.coalesce("verdict", model)).drop(form, model)
