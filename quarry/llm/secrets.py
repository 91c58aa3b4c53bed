"""Secret scan with multipart credential linking; DataFrame expressions only.

Spark has no function that returns the places of all matches.  A text is split at the matches of a
kind (``split`` with all gaps kept) and the matches are extracted beside it; gap and match lengths,
summed in order, give code-point positions.  Only texts with a match take that path.

Base kinds are reported always.  Weak kinds are common shapes that mean little alone: long mixed
base64 runs (``secret``), URLs (``endpoint``) and named accounts (``user``).  The parts of a
credential are access identifiers (``access``, ``user``), secrets (``assign``, ``secret``) and
endpoints.  The scope of a span is all that starts at most ``scope`` code points before or after its
own start, wherever it stands in the text.  An account is reported if a secret lies in its scope, a
weak secret if an access identifier does, an endpoint if both do.  The interval join is a range
window over the starts of one text's spans, so no pairs are made.

All spans of one text are brought together by one shuffle of short rows (no text); a text that holds
most of all spans is one row of the input, too.  Defined cases: null text counts as empty; texts
without spans give empty strings and zero counts; a text of any length is searched whole; spans of
different kinds that start together are all reported, in the order of their kinds; repeated rows are
kept apart; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 400

#: Kinds in report order and their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SECRET = r"[A-Za-z0-9/+=]{40,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+"""
USER = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
KINDS = ("assign", "access", "hex", "secret", "endpoint", "user")
PATTERNS = (ASSIGN, ACCESS, HEX, SECRET, ENDPOINT, USER)
BASE, IDENTIFIERS, SECRETS = 3, (1, 5), (0, 3)


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans_of(kind: int) -> str:
    """SQL for the matches of a kind: array of (kind, number, gap before, length, counts or not)."""
    p = _quoted(PATTERNS[kind])
    wanted = f"t rlike {p}" if kind < BASE or kind in IDENTIFIERS else f"(t rlike {_quoted(ACCESS)} or t rlike {_quoted(USER)}) and t rlike {p}"
    shape = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"
    ok = {0: "length(m.`2`) >= 6", 3: "m.`0` rlike '[0-9]' and m.`0` rlike '[A-Z]' and m.`0` rlike '[a-z]'"}.get(kind, "true")
    found, value = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {2 if kind == 0 else 0})"
    zipped = f"arrays_zip({found}, slice(split(t, {p}, -1), 1, size({found})), {value})"
    made = f"named_struct('kind', {kind}, 'i', i, 'gap', length(m.`1`), 'len', length(m.`0`), 'ok', {ok})"
    return f"case when {wanted} then transform({zipped}, (m, i) -> {made}) else cast(array() as {shape}) end"


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a span that is reported, or one with a null kind for a text without spans: uid, doc_id, kind, start, end."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    found = texts.select("uid", "doc_id", F.explode_outer(F.concat(*(F.expr(_spans_of(k)) for k in range(len(KINDS))))).alias("m"))
    rows = found.select("uid", "doc_id", "m.*").repartition("uid")
    through = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(through)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("kind", F.when(F.col("ok"), F.col("kind")))  # a match that fails leaves its text a row
    around = Window.partitionBy("uid").orderBy("start").rangeBetween(-scope, scope)
    linked = rows.withColumn("identified", F.max(F.col("kind").isin(*IDENTIFIERS)).over(around)).withColumn("secret", F.max(F.col("kind").isin(*SECRETS)).over(around))
    reported = F.expr(f"kind < {BASE} or (kind = 3 and identified) or (kind = 4 and identified and secret) or (kind = 5 and secret)")
    return linked.select("uid", "doc_id", F.when(reported, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"))).alias("span"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    written = f"x -> concat_ws(':', get({names}, x.kind), x.start, x.end)"
    each = spans(docs, scope).groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("all"))
    each = each.withColumn("base", F.expr(f"filter(all, x -> x.kind < {BASE})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return each.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(f"array_join(transform(base, {written}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(all, {written}), ',')").alias("spans"),
    )
