"""URL verdicts: rules first, then a ratio of two character language models.

The models are variable-order Markov chains of characters, one of URLs that
the rules allow and one of those they block: contexts of up to ORDER
characters, each interpolated with the next shorter one (Witten-Bell), down to
an even distribution. All distinct URLs of the table are counted; nothing is
sampled, and the counts are a table that grows with what the URLs hold. A URL's
score is the log-likelihood ratio for each of its characters. The threshold is
calibrated on held-out scores: URLs are halved by hash, the URLs of each half on
which the rules decide are scored by models of the other half alone, and the
threshold is the one that best divides those scores.

Everything is DataFrame work. Levels of the model are small tables joined with
their parents; the scored n-grams meet the URLs' n-grams in one equi-join,
which becomes a broadcast only if adaptive execution finds them small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch, table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
START, END = "\x02", "\x03"
#: Symbols that the even distribution at the bottom spreads over.
SYMBOLS = 256
#: Scores are whole millionths, so that their sums do not depend on the order of the rows.
UNIT = 1_000_000
#: Width of a histogram cell for the threshold, and the cells to either side of zero (the outermost take the rest).
CELL, CELLS = 20_000, 500


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rule(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) by host, its subdomains and path prefix; the longest rule wins."""
    rule = ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def _grams(rows: DataFrame, text: Column) -> DataFrame:
    """A row for each character of the text and one for its end: the character behind its context."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    at = F.sequence(F.lit(1), F.length(text) + 1)
    return rows.withColumn("gram", F.explode(F.transform(at, lambda i: F.substr(padded, i, F.lit(ORDER + 1)))))


def scored_grams(grams: DataFrame, parts: tuple[str, ...] = ("",)) -> DataFrame:
    """``gram`` and, for each part, ``llr`` (whole millionths) for counts (gram, allow, block) of character n-grams; parts end the columns' names."""
    counts = [f"{c}{part}" for part in parts for c in ("allow", "block")]
    levels = [grams]  # by falling length of context
    for k in range(ORDER - 1, -1, -1):
        levels.append(levels[-1].groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(*[F.sum(c).alias(c) for c in counts]))
    below = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.substring("gram", 1, k))  # as many rows as characters follow a context
        level = level.withColumn("shorter", F.right("gram", F.lit(k)))
        for c in counts:
            level = level.withColumn(f"{c}_n", F.sum(c).over(context)).withColumn(f"{c}_t", F.sum((F.col(c) > 0).cast("long")).over(context))
        if below is None:
            level = level.withColumns({f"{c}_p": F.lit(1.0 / SYMBOLS) for c in counts})
        else:
            level = level.join(below.select(F.col("gram").alias("shorter"), *[f"{c}_p" for c in counts]), "shorter")
        for c in counts:
            n, t, p = F.col(f"{c}_n"), F.col(f"{c}_t"), F.col(f"{c}_p")
            level = level.withColumn(f"{c}_p", F.when(n > 0, (F.col(c) + t * p) / (n + t)).otherwise(p))
        below = level.select("gram", *[f"{c}_p" for c in counts])
    ratio = lambda part: F.round((F.log(f"allow{part}_p") - F.log(f"block{part}_p")) * UNIT).cast("long")
    return below.select("gram", *[ratio(part).alias(f"llr{part}") for part in parts])


def _threshold(cells: list[tuple[int, int, int]]) -> int:
    """The cell from which URLs are allowed: the best sum of the two classes' shares on their own side, nearest to zero."""
    allow, block = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not allow or not block:
        return 0
    best, at, below_a, below_b = -math.inf, 0, 0, 0
    by = {c[0]: c[1:] for c in cells}
    for cell in range(-CELLS, CELLS + 2):
        gain = (allow - below_a) / allow + below_b / block
        if gain > best + 1e-12 or abs(gain - best) <= 1e-12 and abs(cell) < abs(at):
            best, at = gain, cell
        a, b = by.get(cell, (0, 0))
        below_a, below_b = below_a + a, below_b + b
    return at


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ``score``, ``held_score`` and ``threshold`` of every row.

    Reads page_id and url. What the models read is the URL behind its scheme,
    lower-cased, whole; a null or empty one scores by its end alone. Repeated
    rows repeat; equal URLs count once in the models and get one score.
    ``held_score`` is the score by models that did not count the URL, null
    where no rule decides. Where the rules leave one class empty, the threshold
    is zero. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    urls = with_rule(rows.select("url").distinct().withColumn("host", host).withColumn("path", path), rules)
    text = F.lower(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    # two hashes with unlike seeds stand for the URL while its characters travel
    keyed = urls.select(F.xxhash64("url").alias("h1"), F.xxhash64(F.lit(1), "url").alias("h2"), "ruled", text.alias("text"))
    each = _grams(keyed, F.col("text")).select("h1", "h2", "ruled", "gram")
    half = F.pmod("h1", F.lit(2))
    seen = [F.count_if((F.col("ruled") == c) & (half == k)).alias(f"{c}{k}") for c in ("allow", "block") for k in (0, 1)]
    both = {c: F.col(f"{c}0") + F.col(f"{c}1") for c in ("allow", "block")}
    ratios = scratch.save(scored_grams(scratch.save(each.groupBy("gram").agg(*seen).withColumns(both)), ("", "0", "1")))
    other = F.when(half == 0, F.col("llr1")).otherwise(F.col("llr0"))
    sums = each.join(ratios, "gram").groupBy("h1", "h2").agg(
        F.sum("llr").alias("llr"), F.sum(other).alias("held"), F.count(F.lit(1)).alias("n"), F.first("ruled", ignorenulls=True).alias("ruled")
    )
    mean = lambda c: F.floor(F.col(c) / F.col("n")).cast("long")
    scored = scratch.save(sums.select("h1", "h2", "ruled", mean("llr").alias("score"), F.when(F.col("ruled").isNotNull(), mean("held")).alias("held")))
    cell = F.greatest(F.lit(-CELLS), F.least(F.lit(CELLS), F.floor(F.col("held") / CELL))).cast("int")
    ruled = scored.where("ruled is not null").groupBy(cell.alias("cell")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    at = _threshold([tuple(r) for r in ruled.collect()]) * CELL  # at most 2 * CELLS + 1 cells
    verdict = F.coalesce("ruled", F.when(F.col("score") >= at, F.lit("allow")).otherwise(F.lit("block")))
    judged = urls.withColumn("h1", F.xxhash64("url")).withColumn("h2", F.xxhash64(F.lit(1), "url")).join(scored.select("h1", "h2", "score", "held"), ["h1", "h2"])
    named = [(F.col("score") / UNIT).alias("score"), (F.col("held") / UNIT).alias("held_score"), F.lit(at / UNIT).alias("threshold")]
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", verdict.alias("verdict"), *named)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
