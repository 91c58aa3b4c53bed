"""DuckDB SQL of the engine queries, over the driver's tables."""

from __future__ import annotations

PRELUDE = """
pkg as (select 'example.com/r' || n_regionkey || '/n' || n_nationkey as pkg_path, case when n_regionkey < 3 then 'example.com/r' || n_regionkey end as module_path,
          n_regionkey = 0 as module_main, n_regionkey = 2 as module_indirect,
          case n_regionkey when 0 then 4 when 1 then 3 when 2 then 2 when 3 then 1 else 0 end::int as tier_rank,
          case n_regionkey when 0 then 'workspace' when 1 then 'direct' when 2 then 'indirect' when 3 then 'stdlib' else 'unknown' end as tier,
          n_nationkey::int as load_order from nation),
imports as (select a.pkg_path src_pkg, b.pkg_path dst_pkg from pkg a join pkg b on (b.load_order = (a.load_order * 2 + 1) % 25 or b.load_order = (a.load_order * 3 + 5) % 25) and a.load_order % 4 <> 3),
sym as (select 'p' || p_partkey as obj_id, case p_partkey % 5 when 0 then 'func' when 1 then 'method' when 2 then 'type' when 3 then 'var' else 'const' end as kind,
          'm/' || (p_partkey % 7) || '.' || p_name as qname, p_name as sname, pkg_path, pkg_path || '/' || p_brand || '.go' as file, p_size as line, (p_partkey % 80 + 1)::int as col,
          tier, tier_rank, p_partkey::int as load_order from part join pkg on p_partkey % 25 = pkg.load_order),
best as (select * from sym qualify row_number() over (partition by qname order by tier_rank desc, load_order) = 1),
placed as (select l.*, o_custkey, pkg_path, tier_rank from lineitem l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join pkg on c_nationkey = pkg.load_order),
uses as (select 'p' || l_partkey as obj_id, 'o' || l_orderkey || '.go' as file, l_linenumber as line, l_quantity::int as col, pkg_path, tier_rank from placed),
nodes as (select case when l_returnflag = 'R' then 'typeassert' else 'call' end as kind, pkg_path, 'o' || l_orderkey || '.go' as file, l_linenumber as line, l_quantity::int as col, l_suppkey::int as visit_seq,
            'm/' || (p_partkey % 7) || '.' || p_name as qname, l_suppkey % 4 as n_args, p_partkey % 5 = 2 as is_type, l_linestatus = 'O' as is_ptr, tier_rank from placed join part on l_partkey = p_partkey),
edges as (select distinct * from (
   select 'c' || o_custkey as caller, 'p' || l_partkey as callee, 'o' || l_orderkey || '.go' as file, l_linenumber as line, l_quantity::int as col from lineitem join orders on l_orderkey = o_orderkey
   union all select 'p' || l_partkey, 's' || l_suppkey, 'o' || l_orderkey || '.go', l_linenumber, l_quantity::int from lineitem
   union all select 's' || s_suppkey, 'c' || c_custkey, 'back.go', 1, 1 from supplier join customer on c_custkey = s_suppkey * 13 or c_custkey = s_suppkey * 7 + 1)),
links as (select distinct caller, callee from edges),
types as (select 't' || c_custkey as type_id, pkg_path || '.T' || c_custkey as qname, pkg_path, 'types.go' as file, c_custkey::int as line, 6 as col, tier_rank, tier from customer join pkg on c_nationkey = pkg.load_order),
msets as (select distinct 't' || o_custkey as type_id, unnest([p_type, 'M' || l_partkey]) as name from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
imethods as (select 'iface0' as iface, p_type as name from part union select 'iface1', p_type from part where p_type[1] in ('E', 'S') union select 'iface2', p_type from part where p_type = 'STANDARD'
   union select 'isup' || s_suppkey, unnest(case when s_suppkey % 2 = 0 then ['M' || (s_suppkey * 2), 'STANDARD'] else ['M' || (s_suppkey * 2)] end) from supplier),
ifaces as (select 'iface' || i as iface from range(4) t(i) union all select 'isup' || s_suppkey from supplier),
impl as (select iface, type_id from ifaces, types where not exists (select 1 from imethods m where m.iface = ifaces.iface and not exists (select 1 from msets s where s.type_id = types.type_id and s.name = m.name))),
sites as (select 's' || s_suppkey as caller, 'isup' || s_suppkey as iface, 'M' || (s_suppkey * 2) as method, 'dyn.go' as file, s_suppkey::int as line, 3 as col from supplier),
vals as (select 's' || s_suppkey as caller, 'p' || c_custkey as callee, 'c' || c_custkey as taker, 'val.go' as file, s_suppkey::int as line, 9 as col from supplier join customer on c_custkey = s_suppkey * 3),
dyn as (select distinct s.caller, '(' || i.type_id || ').' || s.method as callee, i.type_id, s.file, s.line, s.col from sites s join impl i using (iface) join msets m on m.type_id = i.type_id and m.name = s.method),
lines as (select 'vendor/' || source || '/' || doc_id || '.txt' as path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1)::int as line from documents),
fields as (select pkg_path || '.Msg' || (p_partkey % 10) as struct_qname, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') as go_field,
             case when p_partkey % 3 = 2 then '`json:"x"`' else '`protobuf:"varint,' || (p_partkey % 9) || ',opt,name=' || replace(p_name, ' ', '_') || ',proto3" json:"a,omitempty"`' end as tag,
             p_partkey % 4 <> 3 as exported, 'p' || p_partkey as obj_id, pkg_path, p_partkey::int as load_order from part join pkg on p_partkey % 25 = pkg.load_order),
pfields as (select 'Msg' || regexp_extract(struct_qname, 'Msg([0-9]+)$', 1) as proto_message, regexp_extract(tag, 'protobuf:"[^"]*,name=([^,"]*)', 1) as proto_field, go_field, pkg_path, struct_qname,
              struct_qname || '.' || go_field as field_qname, obj_id, load_order from fields where exported and regexp_matches(tag, 'protobuf:"[^"]*,name=')),
changes as (select ts, case event_type when 'click' then 'pkg/u' || user_id || '.go' when 'view' then 'docs/u' || user_id || '.txt' when 'error' then 'pkg/.u' || user_id || '.go' when 'signup' then 'go.mod'
              else 'vendor/u' || user_id || '.go' end as path, event_id % 7 = 0 as chmod from events),
kept as (select * from changes where not chmod and (path = 'go.mod' or (path like 'pkg/u%.go'))),
citations as (select case when doc_id % 11 = 0 then p else p || ':' || l end as citation, p as path, case when doc_id % 11 <> 0 and l >= 1 then l end::int as line, doc_id from (
   select doc_id, case when doc_id % 7 = 0 then 'old/' else '' end || source || '/' || doc_id || '.txt' as p, doc_id % (len(string_split(text, chr(10))) + 1) as l from documents)),
resolved as (select citation, case when regexp_matches(path, 'src1?5/[0-9]+') then 'src1?5/[0-9]+' when regexp_matches(path, '^src[0-9]+/') then '^src[0-9]+/' when regexp_matches(path, 'old/src') then 'old/src' end as pattern,
               'vendor/' || replace(path, 'old/', '') as file, line from citations where line is not null)
"""

HIT = "qname, kind, pkg_path, file, line, tier"
SESSIONS = """
marked as (select ts, case when ts - lag(ts) over (order by ts) > interval '20 minutes' or lag(ts) over (order by ts) is null then 1 else 0 end as begins from kept),
numbered as (select ts, sum(begins) over (order by ts rows unbounded preceding) as s from marked)
select min(ts)::timestamp as started, (max(ts) + interval '20 minutes')::timestamp as due, count(*) as n_events from numbered group by s"""


def _sql(body: str, recursive: bool = False) -> str:
    body = body.strip()
    joint = "," if body.startswith(("marked", "reach", "level", "f0", "starts")) else ""
    return f"with {'recursive ' if recursive else ''}{PRELUDE.strip()}{joint}\n{body}"


def _rta(rounds: int, starts: str) -> str:
    """The double fixpoint, spelled out round by round: f are functions, t types, d dynamic edges so far."""
    out = [f"f0 as ({starts}), t0 as (select ''::varchar as type_id where false)"]
    for k in range(1, rounds + 1):
        out.append(
            f"t{k} as (select distinct 't' || (substr(node, 2)::bigint + 1) as type_id from f{k - 1} where node like 'c%'), "
            f"d{k} as (select dyn.* from dyn join t{k} using (type_id) where caller in (select node from f{k - 1})), "
            f"v{k} as (select caller, callee, file, line, col from vals where taker in (select node from f{k - 1}) and caller in (select node from f{k - 1})), "
            f"f{k} as materialized (select node from f{k - 1} union select callee from links where caller in (select node from f{k - 1}) union select callee from d{k} union select callee from v{k})"
        )
    return ", ".join(out)


ORACLE_SQL: dict[str, str] = {
    "sym_exact": _sql(f"select {HIT} from sym where sname = 'red widget' and tier_rank between 1 and 4"),
    "sym_glob": _sql(f"select {HIT} from sym where regexp_full_match(sname, '.*e.* bo.*t') and tier_rank between 1 and 4"),
    "sym_prefix": _sql(f"select {HIT} from sym where starts_with(sname, 'small') and tier_rank in (3, 4)"),
    "sym_kind": _sql(f"select {HIT} from sym where kind = 'method' and tier_rank between 1 and 4"),
    "sym_scope": _sql(f"select {HIT} from sym where tier_rank in (3, 4)"),
    "sym_tier_dedup": _sql("select qname, obj_id, tier, load_order from best"),
    "sym_by_name": _sql("select sname, string_agg(distinct qname, ',' order by qname) as qnames, count(*) as n from sym group by sname"),
    "sym_index": _sql("select qname, tier from best where tier_rank in (2, 3, 4)"),
    "tier_breakdown": _sql("select tier, count(*) as n from best group by tier"),
    "pkg_classify": _sql("select pkg_path, case when module_path is null then 'stdlib' else tier end as tier, case when module_path is null then 1 else tier_rank end::int as tier_rank from pkg"),
    "pkg_glob": _sql("select pkg_path from pkg where pkg_path = 'example.com/r1' or starts_with(pkg_path, 'example.com/r1/') or pkg_path = 'example.com/r2/n2'"),
    "pkg_flatten": _sql("select pkg_path, case when load_order % 2 = 0 then 'test' else 'regular' end as variant, case when load_order % 2 = 0 then load_order - 3 else load_order end::int as load_order from pkg"),
    "file_last": _sql("select file as path, arg_max(pkg_path, load_order) as pkg_path, max(load_order) as load_order from sym group by file"),
    "refs_scope": _sql("select distinct file, line, col from uses where obj_id in (select obj_id from best where qname = 'm/3.red widget') and tier_rank = 4 and starts_with(pkg_path, 'example.com/r0/')"),
    "refs_all": _sql("select distinct file, line, col from uses where obj_id in (select obj_id from best where qname = 'm/3.red widget')"),
    "refs_limit": _sql("select *, count(*) over () >= 5 as truncated from (select distinct file, line, col from uses where obj_id in (select obj_id from best where qname = 'm/3.red widget') order by file, line, col limit 5)"),
    "refs_count": _sql("select qname, uses.tier_rank, count(*) as n from uses join sym using (obj_id) group by all"),
    "definition_at": _sql("""
select p.file as at_file, p.line as at_line, p.c as at_col, arg_min(s.qname, w) as qname, arg_min(s.kind, w) as kind, arg_min(s.file, w) as file, arg_min(s.line, w) as line, arg_min(s.col, w) as col
from (select distinct file, line, col + 2 as c from uses) p
join (select *, col + 2 + substr(obj_id, 2)::int % 9 as e, row(2 + substr(obj_id, 2)::int % 9, col, obj_id) as w from uses) i on i.file = p.file and i.line = p.line and i.col <= p.c and p.c < i.e
join sym s on s.obj_id = i.obj_id group by 1, 2, 3"""),
    "implementations_all": _sql("select iface, type_id from impl"),
    "implements_structural": _sql("select qname, pkg_path, file, line, col from types where type_id in (select type_id from impl where iface = 'iface1') and starts_with(pkg_path, 'example.com/r1/')"),
    "implements_indexed": _sql("select qname, 'type' as kind, pkg_path, file, line, tier from types where type_id in (select type_id from impl where iface = 'iface0') and tier_rank between 1 and 4"),
    "ast_call": _sql("select qname, pkg_path, file, line, col from nodes where kind = 'call' and tier_rank = 4 and regexp_full_match(qname, 'm/.*\\.red .*') qualify row_number() over (partition by file, line, col order by pkg_path, visit_seq, qname) = 1"),
    "ast_call_nargs": _sql("select qname, pkg_path, file, line, col from nodes where kind = 'call' and n_args = 2 and starts_with(qname, 'm/2') and starts_with(pkg_path, 'example.com/') qualify row_number() over (partition by file, line, col order by pkg_path, visit_seq, qname) = 1"),
    "ast_conv": _sql("""
select qname, pkg_path, file, line, col from (
  select '*' || qname as qname, pkg_path, file, line, col, visit_seq from nodes where kind = 'call' and n_args = 1 and is_type and is_ptr and qname = 'm/3.red widget'
  union all select qname, pkg_path, file, line, col, visit_seq from nodes where kind = 'call' and n_args = 1 and is_type and not is_ptr and qname = 'm/4.small bolt')
qualify row_number() over (partition by qname, file, line, col order by pkg_path, visit_seq) = 1"""),
    "ast_typeassert": _sql("select '*' || qname as qname, pkg_path, file, line, col from nodes where kind = 'typeassert' and is_ptr and qname = 'm/3.red widget' qualify row_number() over (partition by file, line, col order by pkg_path, visit_seq) = 1"),
    "ast_dedup": _sql("select qname, pkg_path, file, line, col from nodes where kind = 'call' qualify row_number() over (partition by file, line, col order by pkg_path, visit_seq, qname) = 1"),
    "html_links": """select page_id, unnest(range(len(h)))::int as n, unnest(h) as href from (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages)""",
    "callers": _sql("select caller, callee, file, line, col from edges where callee = 'p42'"),
    "callees": _sql("select caller, callee, file, line, col from edges where caller = 's7'"),
    "edge_dedup": _sql("select caller, count(*) as n, count(distinct callee) as callees from edges group by caller"),
    "two_hop": _sql("select distinct a.caller as src, b.callee as dst from links a join links b on a.callee = b.caller where a.caller = 'c1'"),
    "reach_depth": _sql("level(node, depth) as (select 'c1', 0 union select callee, depth + 1 from level join links on caller = node where depth < 12) select node, min(depth)::int as depth from level group by node", True),
    "reverse_trace": _sql("""
level(node, depth) as (select 'c1', 0 union select callee, depth + 1 from level join links on caller = node where depth < 12),
near as (select node, min(depth) as depth from level group by node),
parents as (select e.callee as node, min(row(e.caller, e.file, e.line, e.col)) as p from edges e join near a on a.node = e.caller join near b on b.node = e.callee and b.depth = a.depth + 1 group by e.callee),
walk as (select n.depth as d, n.node, p.p from near n join parents p using (node) where n.node = 's33' union all select walk.d - 1, parents.node, parents.p from walk join parents on parents.node = walk.p[1] where walk.d > 1)
select (d - 1)::int as step, p[1] as caller, node as callee, p[2] as file, p[3] as line, p[4] as col from walk""", True),
    "cha_edges": _sql("select caller, count(*) as n, count(distinct callee) as callees from (select caller, callee, file, line, col from edges union select caller, callee, file, line, col from dyn union select caller, callee, file, line, col from vals) group by caller"),
    "rta_reachable": _sql(_rta(14, "select 'c1' as node") + " select node from f14"),
    "rta_edges": _sql(_rta(14, "select unnest(['s0', 's50']) as node") + " select caller, count(*) as n from (select caller, callee, file, line, col from edges where caller in (select node from f14) union select caller, callee, file, line, col from d14 union select * from v14) group by caller"),
    "rta_missing": _sql("select node from (select unnest(['c1', 'zz']) as node) where node not in (select caller from edges union select callee from edges)"),
    "fn_variants": _sql("select qname, count(*) as n, string_agg(obj_id, ',' order by obj_id) as fn_ids from sym where load_order % 11 <> 0 group by qname"),
    "fn_variant_edges": _sql("select distinct callee, file, line, col from edges where caller in (select obj_id from sym where qname = 'm/3.red widget' and load_order % 11 <> 0)"),
    "value_edges": _sql("select caller, callee, file, line, col from vals"),
    "root_edges": _sql("select distinct '<root>' as caller, callee, file, line, col from edges where starts_with(caller, 's')"),
    "exported_fields": _sql("select obj_id, regexp_matches(go_field, '^[A-Z]') as upper, false as lower from fields"),
    "ref_texts": _sql("select obj_id, count(*) || ' reference(s)' || chr(10) || string_agg(file || ':' || line || ':' || col, chr(10) order by file, line, col) as text from uses group by obj_id"),
    "edge_texts": _sql("select caller || ' -> ' || callee || '  ' || file || ':' || line || ':' || col as text from edges where callee = 'p42'"),
    "absolute_path": _sql("select obj_id, case when line % 2 = 0 then '/' || file else '/src/app/' || file end as path from sym"),
    "watch_folders": "select distinct unnest(['.', case event_type when 'view' then 'docs' when 'click' then 'pkg' when 'error' then 'pkg' else '.' end]) as folder from events where event_id % 7 = 1",
    "tree_changes": "select source || '/' || doc_id as path, case when doc_id % 3 = 0 then 'create' when doc_id % 5 = 0 then 'remove' else 'write' end as op from documents where (doc_id % 3 = 0) <> (doc_id % 5 = 0) or (doc_id % 3 <> 0 and doc_id % 5 <> 0 and doc_id % 7 = 0)",
    "import_closure": _sql("reach(pkg_path, depth) as (select pkg_path, 0 from pkg where load_order = 2 union select dst_pkg, depth + 1 from reach join imports on src_pkg = pkg_path where depth < 25) select pkg_path, min(depth)::int as depth from reach group by pkg_path", True),
    "cite_split": _sql("select citation, path, line from citations"),
    "cite_line": _sql("select citation, pattern, file, line, text as line_text from resolved join lines on file = path and resolved.line = lines.line") .replace("select citation, pattern, file, line, text", "select citation, pattern, file, resolved.line, text"),
    "cite_context": _sql("select citation, string_agg(text, chr(10) order by lines.line) as context, min(lines.line) as context_line from resolved join lines on file = path and lines.line between resolved.line - 2 and resolved.line + 2 group by citation, resolved.line having bool_or(lines.line = resolved.line)"),
    "line_window": "select doc_id, array_to_string(ls[2:4], chr(10)) as context from (select doc_id, string_split(text, chr(10)) as ls from documents) where array_to_string(ls[2:4], chr(10)) <> ''",
    "position_offset": "select doc_id, least(coalesce(list_sum(list_transform(ls[1:l - 1], lambda s: strlen(s) + 1)), 0) + 3, strlen(text))::int as byte from (select doc_id, text, string_split(text, chr(10)) as ls, (doc_id % 4)::int as l from documents) where l between 1 and len(ls)",
    "clip": "select doc_id, case when length(text) > 200 then text[1:100] || chr(10) || '… output clipped …' || chr(10) || text[-100:] else text end as clipped from documents",
    "docs_clip": "select 'page/7' as path, case when length(html) > 1000 then html[1:500] || chr(10) || '… output clipped …' || chr(10) || html[-500:] else html end as text from pages where page_id = 7",
    "module_list": _sql("""select string_agg(j, chr(10) order by j) as text from (select '{"Path":"' || module_path || '","Main":' || max(module_main) || ',"Indirect":' || min(module_indirect) || '}' as j from pkg where module_path is not null group by module_path)"""),
    "module_paths": _sql("select pkg_path || '/go.mod' as path, module_path as module from pkg where module_path is not null union all select pkg_path || '/go.mod', 'go' from pkg where module_path is null"),
    "mime": """select p as path, case lower(regexp_extract(p, '(\\.[^./]*)$', 1)) when '.md' then 'text/markdown' when '.yaml' then 'application/yaml' when '.yml' then 'application/yaml' when '.json' then 'application/json' when '.go' then 'text/x-go' else 'text/plain' end as mime
from (select url || ['.md', '.GO', '.yaml', '.x', ''][page_id % 5 + 1] as p from pages)""",
    "safe_path": """select case when b = '' then b else b || '/' || p_partkey end as path, b in ('a/../b', 'a//b/..', 'x') as safe
from (select p_partkey, ['a/../b', '../a', '/a', 'a/./b/../../c', 'a/../../b', '', 'a//b/..', 'x'][p_partkey % 8 + 1] as b from part)""".replace("b in ('a/../b', 'a//b/..', 'x')", "b in ('a/../b', 'a/./b/../../c', 'a//b/..', 'x')"),
    "relative_path": _sql("select obj_id, case when starts_with(file, 'example.com/r1/') then file[16:] else file end as path from sym"),
    "resources_read": "select 'repo:docs/' || doc_id || '.md' as uri, 'text/markdown' as mime, text from documents where doc_id in (1, 5)",
    "split_list": "select p_partkey, p_name || '|' || p_type as items from part",
    "strip_names": _sql("select obj_id, '(*' || qname || ').M' as qname, pkg_path from sym"),
    "qualify_names": _sql("select obj_id, case when kind = 'method' then '(' || case when line % 2 = 0 then '*' else '' end || pkg_path || '.T' || line || ').' || replace(sname, ' ', '_') else pkg_path || '.' || replace(sname, ' ', '_') end as qname from sym"),
    "hit_texts": _sql("select obj_id, file || ':' || line || '  [' || tier || ' ' || kind || ']  ' || qname as hit, file || ':' || line || ':' || col as at from sym"),
    "proto_fields": _sql("select proto_message, proto_field, go_field, pkg_path, struct_qname, field_qname from pfields"),
    "proto_field": _sql("select proto_message, proto_field, arg_min(field_qname, load_order) as field_qname, arg_min(obj_id, load_order) as obj_id from pfields where starts_with(pkg_path, 'example.com/r0/') group by 1, 2"),
    "proto_xref": _sql("select distinct file, line, col from uses where tier_rank = 4 and obj_id = (select arg_min(obj_id, load_order) from pfields where proto_message = 'Msg0' and proto_field = 'red_widget')"),
    "lint_banned": _sql("""select distinct 'bannedinscope' as analyzer, 'error' as severity, file, line, col, 'call to banned ' || qname || ' in scope ' || pkg_path as message, 'bannedinscope' as category
from nodes where kind = 'call' and (regexp_full_match(qname, 'm/1\\.red .*') or regexp_full_match(qname, 'm/.*\\.small bolt')) and (starts_with(pkg_path, 'example.com/r0/') or pkg_path = 'example.com/r1/n1')"""),
    "lint_all_scopes": _sql("select file, count(*) as n, min(message) as message from (select distinct file, line, col, 'call to banned ' || qname || ' in scope ' || pkg_path as message from nodes where kind = 'call' and regexp_full_match(qname, '.*\\.red widget') and starts_with(pkg_path, 'example.com/r2/')) group by file"),
    "watch_relevant": _sql("select path, count(*) as n from kept group by path"),
    "reload_sessions": _sql(SESSIONS),
    "reload_stream": _sql(SESSIONS),
}
