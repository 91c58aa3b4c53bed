"""Quality rules per document, and host-level verdicts from shrunk failure rates.

Main path: DataFrame expressions only.  Base rules are exact counts on the whole text.  A document
*fails* when a base rule or one of the shape rules (symbols, repeated lines, word length) fires at
its usual limit.  Failures are added up by host (a source, a domain column, or ``domain`` of a URL),
and each host's rate is shrunk towards the corpus by a beta prior that is fitted to all hosts by
moments, binomial noise taken off.  The verdict on a host is its strictness: the shrunk rate in
percent of the corpus's rate, within 50 to 200.  It is joined back, and the limits of the symbol and
line rules of its documents are divided by it: a host that fails twice as often as usual gets half
the room, a clean one up to twice as much.  A document is kept if no base rule fires and no shape
rule at the limits of its host.

Repeated words: 8-word windows are compared by a 64-bit hash that is built by doubling (1, 2, 4, 8
words), so a window costs four hash steps and no string is built.  Positions of repeated windows are
only worked out for texts that have one.

The host table is broadcast after its row count was checked; beyond the limit the join is salted, so
one host may hold any share of the documents.

Defined cases: null text counts as empty (no words, base failed); a text of any length is measured
whole, in one row; null host is a host of its own; a count that equals a limit passes; repeated rows
are each judged, and count as often as they stand; an empty table gives an empty result; extra
columns pass through ``filter_documents`` whatever their names, as own columns stand beside a struct
that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = r"[\x20\x09-\x0D]+"
BROADCAST_HOSTS = 100_000
SALTS = 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: Shape rules at ``strict`` percent: symbols above a tenth of the words, repeated lines above half of the lines.
SHAPE = "10 * n_symbols * strict > 100 * n_words or 2 * n_dup_lines * strict > 100 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words"


def domain(url: Column) -> Column:
    """Host name of a URL in lower case; null without one."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def measured(docs: DataFrame, keep: list[str], host: str | Column | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``host``, ``n_lines`` and the measures."""
    host = F.lit(None).cast("string") if host is None else F.col(f"`{host}`") if isinstance(host, str) else host
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), host.alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    one = base.withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    two = one.withColumns(
        {
            "n": F.size("w").cast("long"),
            "chars": F.length(F.array_join("w", "")).cast("long"),
            "symbols": (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long"),
            "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "h1": F.transform("w", lambda x: F.xxhash64(x)),
        }
    ).drop("w", "t")
    step = two
    for width in (1, 2, 4):
        step = step.withColumn(f"h{2 * width}", F.expr(f"transform(h{width}, (x, i) -> xxhash64(x, get(h{width}, i + {width})))")).drop(f"h{width}")
    step = step.withColumn("win", F.expr("slice(h8, 1, greatest(size(h8) - 7, 0))")).drop("h8")
    step = step.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    step = step.withColumn("sorted", F.expr("case when again then sort_array(transform(win, (h, i) -> named_struct('h', h, 'i', i))) end")).drop("win")
    step = step.withColumn("at", F.expr("sort_array(transform(filter(sorted, (x, j) -> get(sorted, j - 1).h <=> x.h or get(sorted, j + 1).h <=> x.h), x -> x.i))")).drop("sorted")
    repeated = F.expr("coalesce(aggregate(transform(at, (x, k) -> least(8, coalesce(get(at, k + 1), x + 8) - x)), 0L, (a, b) -> a + cast(b as bigint)), 0L)")
    return step.select(
        "row",
        "host",
        F.col("n").alias("n_words"),
        F.col("chars").alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )


def hosts(found: DataFrame) -> DataFrame:
    """Per host (``named``): documents, failures, the rate shrunk by the fitted beta prior, and the strictness.

    The prior's mean is the rate of the corpus; its weight follows from the variance between hosts
    (each weighing as many documents as it has) beyond what draws at one rate would show.  Without
    such variance every host gets the corpus's rate.
    """
    each = found.groupBy(F.col("host").alias("named")).agg(F.count("*").alias("docs"), F.count(F.when(F.col("fails"), 1)).alias("failures"))
    squares = F.sum(F.col("failures") * F.col("failures") / F.col("docs"))
    sums = each.agg(F.sum("failures").alias("f"), F.sum("docs").alias("n"), squares.alias("q"), F.count("*").alias("hosts")).first()  # one row
    m = sums.f / sums.n if sums.n else 0.0
    most = m * (1 - m)
    spread = (sums.q - most * sums.hosts) / sums.n - m * m if sums.n else 0.0
    weight = most / spread - 1 if 1e-9 < spread < most else 1e6
    each = each.withColumn("shrunk", (F.col("failures") + F.lit(m * weight)) / (F.col("docs") + F.lit(weight)))
    percent = F.round(100 * F.col("shrunk") / F.lit(m)).cast("long") if m else F.lit(100).cast("long")
    return each.withColumn("strict", F.greatest(F.least(percent, F.lit(200)), F.lit(50)).cast("long"))


def judged(docs: DataFrame, keep: list[str], host: str | Column = "source") -> DataFrame:
    """``row``, measures, ``base_failed``, the host's ``shrunk`` rate and ``strict``, and ``kept``."""
    found = measured(docs, keep, host).withColumn("base_failed", F.expr(BASE))
    found = common.materialize(found.withColumn("fails", F.expr(f"base_failed or {SHAPE.replace('strict', '100')}")), "rules")
    verdicts = common.materialize(hosts(found).select("named", "shrunk", "strict"), "hosts")
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = found.join(F.broadcast(verdicts), found["host"].eqNullSafe(verdicts["named"]), "left")
    else:
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = found.withColumn("own", F.pmod(F.xxhash64("n_lines", *MEASURES), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, dealt["host"].eqNullSafe(salted["named"]) & (dealt["own"] == salted["salt"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.expr(SHAPE))


def report(docs: DataFrame, host: str | Column = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, the host's shrunk rate and its strictness in percent."""
    out = judged(docs, ["doc_id"], host)
    return out.select("row.doc_id", *MEASURES, "base_failed", "kept", F.round("shrunk", 6).alias("host_rate"), F.col("strict").alias("host_strict"))


def filter_documents(docs: DataFrame, host: str | Column = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    out = judged(docs, docs.columns, host).where("kept")
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
