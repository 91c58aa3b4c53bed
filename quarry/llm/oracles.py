"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {}

#: The five counts of the quality rules, one row a document (rid tells repeated rows apart).
MEASURES = rf"""
docs as (select row_number() over () rid, *, coalesce(text, '') t from documents),
listed as (select rid, doc_id, source, t, regexp_extract_all(t, '{WORD}') ws,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from docs),
placed as (select rid, unnest(ws) w, generate_subscripts(ws, 1) i from listed),
windows as (select rid, i, w || chr(32) || lead(w, 1) over p || chr(32) || lead(w, 2) over p || chr(32) || lead(w, 3) over p
              || chr(32) || lead(w, 4) over p || chr(32) || lead(w, 5) over p || chr(32) || lead(w, 6) over p || chr(32) || lead(w, 7) over p as win
            from placed window p as (partition by rid order by i)),
counted as (select rid, i, win is not null and count(*) over (partition by rid, win) > 1 as again from windows),
covered as (select rid, max(again) over (partition by rid order by i rows between 7 preceding and current row) as hit from counted),
repeats as (select rid, count(*) filter (where hit) n from covered group by rid),
measures as (
  select l.rid, doc_id, source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls)::bigint n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words
  from listed l left join repeats r using (rid)),
failed as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words as shape_failed
  from measures),
by_host as (select source, count(*) n, count(*) filter (where base_failed or shape_failed) f from failed group by source),
moments as (select sum(f) / sum(n) m, sum(f * f / n) q, sum(n) total, count(*) hosts from by_host),
spread as (select m, m * (1 - m) most, (q - m * (1 - m) * hosts) / total - m * m v from moments),
prior as (select m, case when v > 1e-9 and v < most then most / v - 1 else 1e6 end s from spread),
verdicts as (select source, case when m > 0 then greatest(least(round(100 * ((f + m * s) / (n + s)) / m), 200), 50)::bigint else 100 end as strict from by_host, prior)
"""

ORACLE_SQL["op6_quality_rules"] = f"""
with {MEASURES}
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (10 * n_symbols * strict > 100 * n_words or 2 * n_dup_lines * strict > 100 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from failed f join verdicts v on f.source is not distinct from v.source
"""

_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
_USER = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY](?:_?[iI][dD])?)["\x27]?\x20*[:=]\x20*["\x27]?[A-Za-z0-9+/_.@-]{3,}"""
_IDENTIFIED = f"(regexp_matches(t, 'AKIA[A-Z0-9]{{16,}}') or regexp_matches(t, '{_USER}'))"
_ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"\x27<>]+"""


def _kind(number: int, pattern: str, value: int, ok: str, extra: str = "true") -> str:
    return f"""
    select rid, {number} k, {('assign', 'access', 'hex', 'secret', 'endpoint', 'user')[number].__repr__()} kind, i, gap, x, {ok} ok from (
      select rid, unnest(range(1, len(m) + 1)) i, unnest(m) x, unnest(v) val, unnest(g[1:len(m)]) gap from (
        select rid, regexp_extract_all(t, '{pattern}', 0) m, regexp_extract_all(t, '{pattern}', {value}) v, string_split_regex(t, '{pattern}') g
        from docs where regexp_matches(t, '{pattern}') and {extra}))"""


ORACLE_SQL["op5_secret_scan"] = rf"""
with docs as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
matches as ({' union all '.join((
    _kind(0, _ASSIGN, 2, "length(val) >= 6"),
    _kind(1, 'AKIA[A-Z0-9]{16,}', 0, 'true'),
    _kind(2, '[0-9a-f]{24,}', 0, 'true'),
    _kind(3, '[A-Za-z0-9/+=]{40,}', 0, "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]')", _IDENTIFIED),
    _kind(4, _ENDPOINT, 0, 'true', _IDENTIFIED),
    _kind(5, _USER, 0, 'true'),
))}),
placed as (select rid, k, kind, ok, sum(length(gap) + length(x)) over (partition by rid, k order by i)::bigint e, length(x) n from matches),
spans as (select rid, k, kind, e - n s, e from placed where ok),
near as (select *, bool_or(k in (1, 5)) over w a, bool_or(k in (0, 3)) over w p from spans window w as (partition by rid order by s range between 400 preceding and 400 following)),
shown as (select rid, k, kind, s, e from near where k < 3 or (k = 3 and a) or (k = 4 and a and p) or (k = 5 and p)),
joined as (
  select rid, count(*) filter (where k = 0) n0, count(*) filter (where k = 1) n1, count(*) filter (where k = 2) n2,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (where k < 3) base,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) al
  from shown group by rid)
select doc_id, coalesce(n0, 0)::bigint n_assign, coalesce(n1, 0)::bigint n_access, coalesce(n2, 0)::bigint n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(al, '') spans
from docs left join joined using (rid)
"""

ORACLE_SQL["op10_decontaminate"] = rf"""
with items as (select coalesce(item_id::varchar, 'null') item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') ws from benchmark where text is not null),
parts as (select item, ws, least(10, len(ws)) n from items where len(ws) > 0),
windows as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') win from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) i from parts)),
docs as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') ws from documents),
sizes as (select distinct n from windows),
spans as (select rid, i, n, array_to_string(ws[i:i + n - 1], ' ') win from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) i from docs, sizes)),
found as (select rid, i, n, item from spans join windows using (n, win)),
hit as (select rid, count(distinct w)::bigint n_hit from (select rid, unnest(range(i, i + n)) w from found) group by rid),
named as (select rid, count(*)::bigint n_items, string_agg(item, ',' order by item) names from (select distinct rid, item from found) group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join hit using (rid) left join named using (rid)
"""

ORACLE_SQL["op2_ngram_join"] = rf"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws from documents),
sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
         else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end s from docs),
one as (select doc_id, len(s)::bigint n, unnest(s) sh from sets),
pairs as (select a.doc_id x, b.doc_id y, a.n nx, b.n ny, count(*) i from one a join one b on a.sh = b.sh and a.doc_id < b.doc_id
          and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
links as (select x, y from pairs where 100 * i >= 90 * (nx + ny - i)),
ways as (select x, y from links union all select y, x from links),
reach(a, b) as (select doc_id, doc_id from sets union select reach.a, ways.y from reach join ways on reach.b = ways.x)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.b) component_id from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""

ORACLE_SQL["op7_line_dedup"] = r"""
with docs as (select coalesce(doc_id, 9223372036854775807) d, doc_id, coalesce(text, '') t from documents),
raw as (select d, doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) - 1 n from docs),
lines as (select * from (select d, doc_id, n, regexp_extract_all(line, '[^\x20\x09-\x0D]+') ws from raw) where len(ws) > 0),
firsts as (select ws, min(struct_pack(d := d, n := n)) p from lines group by ws),
longs as (select p, w, case when wordy then ws else list_transform(range(1, length(s) + 1), lambda i: substr(s, i::int, 1)) end us, wordy
          from (select ws, p, s, len(ws) >= 5 wordy, case when len(ws) >= 5 then 'w' else 'c' end || s w from (select ws, p, array_to_string(ws, ' ') s from firsts)) where wordy or length(s) >= 5),
deletions as (select w, p, i, case when wordy then 'w' || array_to_string(list_concat(us[1:i - 1], us[i + 1:]), ' ') else 'c' || array_to_string(list_concat(us[1:i - 1], us[i + 1:]), '') end v
              from (select *, unnest(range(1, len(us) + 1)) i from longs)),
by_place as (select v, i, min(p) p from deletions group by v, i),
by_variant as (select v, min(p) p from deletions group by v),
near as (
  select w from deletions join by_place b using (v, i) where b.p < deletions.p
  union select x.w from deletions x join longs y on x.v = y.w where y.p < x.p
  union select y.w from longs y join by_variant b on b.v = y.w where b.p < y.p),
judged as (
  select l.d, l.doc_id, l.n, struct_pack(d := l.d, n := l.n) <> f.p as exact, near.w is not null as close
  from lines l join firsts f using (ws) left join near on near.w = case when len(l.ws) >= 5 then 'w' else 'c' end || array_to_string(l.ws, ' ')),
each as (
  select d, count(*) n_lines, count(*) filter (where exact) n_exact, count(*) filter (where close and not exact) n_near,
         string_agg(n::varchar, ',' order by n) filter (where exact or close) removed from judged group by d)
select docs.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_exact, 0)::bigint n_exact, coalesce(n_near, 0)::bigint n_near, coalesce(removed, '') removed
from docs left join each using (d)
"""

ORACLE_SQL["op4_warc"] = """
with pages_ as (select page_id, coalesce(html, '') as html from pages),
digits as (select page_id, html, sha1(html) as h, max(page_id) over (partition by html) as best from pages_),
coded as (select page_id, html, best, array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) % 32 + 1, 1)), '') as d from digits)
select page_id, strlen(html)::bigint as payload_bytes, d as payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id <> best then best end as refers_to from coded
"""
