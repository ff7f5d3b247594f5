"""SQL counterparts, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from panelwright.llm import secrets, sharding

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(percent: int = 85) -> str:
    text = ASCII_LOWER.format("coalesce(text, '')")
    return rf"""
with recursive docs as (
    select row_number() over () as r, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') as w from documents
), sets as (
    select r, doc_id, case when len(w) = 0 then []
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from docs
), lines as (select r, len(s) as n, unnest(s) as g from sets),
pairs as (
    select a.r as a, b.r as b, a.n as n, b.n as m, count(*) as common from lines a join lines b on a.g = b.g and a.r < b.r
    where 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by all
), links as (
    select a, b from pairs where 100 * common >= {percent} * (n + m - common)
    union all select b, a from pairs where 100 * common >= {percent} * (n + m - common)
), reach(r, o) as (
    select r, r from sets union select reach.r, links.b from reach join links on links.a = reach.o
), named as (
    select reach.r, min(sets.doc_id) as component_id from reach join sets on sets.r = reach.o group by reach.r
)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id is not distinct from component_id as kept
from sets join named using (r)"""


def shard_places(shards: list[str], slots: int = 65_537) -> str:
    owner = ",".join(map(str, sharding.fill_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
with placed as (
    select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {slots})::int as slot from documents
), owners as (select unnest([{owner}]) as owner, unnest(range({slots})) as slot)
select doc_id, slot, ([{names}])[owner + 1] as shard from placed join owners using (slot)"""


def secret_spans() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    found = "\nunion all\n".join(
        f"""select r, {no} as no, {quoted(rule.kind)} as kind, unnest(range(1, len(hits) + 1)) as i, pieces, hits, groups from (
    select r, string_split_regex(text, {quoted(rule.pattern)}) as pieces, regexp_extract_all(text, {quoted(rule.pattern)}) as hits,
        regexp_extract_all(text, {quoted(rule.pattern)}, {rule.group}) as groups from docs)"""
        for no, rule in enumerate(secrets.RULES)
    )
    least = " ".join(f"when {no} then {rule.least}" for no, rule in enumerate(secrets.RULES))
    counts = ", ".join(
        f"count(*) filter (where kind = {quoted(r.kind)}) as n_{r.kind}" for r in secrets.BASE)
    line = "kind || ':' || start || ':' || stop"
    return rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({found}), placed as (
    select r, no, kind, length(hits[i]) as size, length(groups[i]) as own,
        list_sum([length(p) for p in pieces[1:i]]) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) as start from found
), spans as (
    select r, no, kind, start::int as start, (start + size)::int as stop from placed where own >= case no {least} end
), joined as (
    select r, {counts}, coalesce(string_agg({line}, ',' order by start, no) filter (where no < {len(secrets.BASE)}), '') as base,
        string_agg({line}, ',' order by start, no) as spans from spans group by r
)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secrets.BASE)},
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join joined using (r)"""


EMBEDDINGS = """
with recursive rows as (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
good as (
    select r, label, v from rows where label is not null and len(v) > 0 and not list_contains([x is null for x in v], true)
        and not list_contains([isfinite(x) for x in v], false) and list_contains([x <> 0 for x in v], true)
), links as (
    select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98
), reach(r, o) as (
    select r, r from rows union select reach.r, links.b from reach join links on links.a = reach.o
), named as (select reach.r, min(rows.vec_id) as component_id from reach join rows on rows.r = reach.o group by reach.r),
counted as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from rows join named using (r) left join counted using (r)"""


def repeats(length: int = 200) -> str:
    return f"""
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
sized as (select r, doc_id, x, (length(x) // 2)::bigint as n from docs),
starts as (select r, x, unnest(range(n - {length - 1})) as s from sized where n >= {length}),
keyed as (select r, s, md5(substr(x, 2 * s + 1, {2 * length})) as k from starts),
hits as (select r, s from (select r, s, count(*) over (partition by k) as c from keyed) where c > 1),
runs as (
    select r, min(s) as a, max(s) + {length} as b from (
        select r, s, sum(fresh) over (partition by r order by s) as run from (
            select r, s, case when s - lag(s) over (partition by r order by s) <= {length} then 0 else 1 end as fresh from hits))
    group by r, run
), removed as (
    select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, list(a order by a) as starts, list(b order by a) as stops from runs group by r
), kept as (
    select doc_id, n, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, case when starts is null then x else
        array_to_string([substr(x, 2 * z[1] + 1, 2 * (z[2] - z[1])) for z in list_zip([0] || stops, starts || [n])], '') end as rest
    from sized left join removed using (r)
)
select doc_id, n as n_bytes, n_removed, n_spans, sha256(unhex(rest)) as kept_sha256 from kept"""


def manifest(fan: int = 16, inside: int = 6, above: int = 4) -> str:
    """``inside`` levels of leaves in a source and ``above`` levels of sources at most."""
    part = "coalesce(octet_length({0}::varchar::blob)::varchar || ':' || {0}::varchar, '-')"
    text = "coalesce(octet_length(encode({0}))::varchar || ':' || {0}, '-')"
    heads = [part.format("doc_id"), text.format("source"), text.format("lang"), part.format("n_chars")]
    lower = f"case when coalesce(crc % 5 = 0, false) then {ASCII_LOWER.format('text')} else text end"
    leaf = " || ".join([*heads, text.format("text")])
    other = " || ".join([*heads, text.format(f"({lower})")])

    def levels(name: str, most: int) -> str:
        out = []
        for k in range(most):
            run = f"over (partition by g, p // {fan} order by p rows between"
            out.append(f"""{name}s{k} as (
    select g, p, c, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as a,
        coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as b from (select *, count(*) over (partition by g) as c from {name}{k})
), {name}{k + 1} as (
    select g, p // {fan} as p, case when any_value(c) = 1 then any_value(d) else sha256(string_agg(d, '' order by p)) end as d
    from (select *, count(*) over (partition by g) as c from {name}{k}) group by g, p // {fan})""")
        return ",\n".join(out)

    def climb(name: str, most: int, rows: str, group: str, place: str) -> tuple[str, str]:
        out, last = [], rows
        for k in range(most):
            out.append(f"""{name}f{k} as (
    select l.* replace (case when s.c > 1 then sha256(s.a || l.cur || s.b) else l.cur end as cur,
        case when s.c > 1 then l.proof || s.a || s.b else l.proof end as proof)
    from {last} l join {name}s{k} s on l.{group} = s.g and l.{place} // {fan**k} = s.p)""")
            last = f"{name}f{k}"
        return ",\n".join(out), last

    low, last = climb("t", inside, "leaves", "g", "p")
    high, end = climb("u", above, "tops", "one", "q")
    return f"""
with docs as (
    select *, xor(4294967295, list_reduce([4294967295::bigint] || [ord(x)::bigint for x in string_split(doc_id::varchar, '')],
        lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) as crc from documents
), hashed as (
    select doc_id, coalesce('=' || source, '') as g, sha256({leaf}) as leaf, sha256({other}) as other from docs
), leaves as (
    select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, other as cur, '' as proof from hashed
), t0 as (select g, p, leaf as d from leaves),
{levels("t", inside)},
subroots as (select g, d as subroot, '' as one, row_number() over (order by encode(g)) - 1 as q from t{inside}),
u0 as (select '' as g, q as p, subroot as d from subroots),
{levels("u", above)},
{low},
tops as (select {last}.*, s.subroot, s.one, s.q from {last} join subroots s using (g)),
{high}
select doc_id, leaf, subroot, (select d from u{above}) as root, sha256(proof) as proof_sha256, cur as folded_root,
    cur = (select d from u{above}) as verified from {end}"""


NEAREST = """
with rows as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (
    select r, vec_id, [floor(256 * x) for x in e] as v from rows
    where e is not null and not list_contains([x is null for x in e], true) and not list_contains([isfinite(x) for x in e], false)
), scored as (
    select a.r, a.vec_id as query_id, b.vec_id, b.r as other, list_inner_product(a.v, b.v)::bigint as score
    from good a join good b on a.vec_id % 50 = 0 and a.r <> b.r and len(a.v) = len(b.v)
)
select query_id, row_number() over (partition by r order by score desc, vec_id nulls last, other)::int as rank, vec_id, score
from scored qualify rank <= 5"""


def clusters(size: int = 64, k: int = 16, rounds: int = 3, factor: int = 64) -> str:
    far = "list_inner_product(x.v, x.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"n{i} as (select r, min([{far}, c.k]) as best from kept x, c{i} c group by r)")
        if i < rounds:
            steps.append(f"""m{i} as (
    select k, list(f order by i) as v from (
        select best[2] as k, i, floor(sum(x.v[i]) / count(*)) as f from kept x join n{i} using (r), (select unnest(range(1, {size} + 1)) as i) group by all
    ) group by k
), c{i + 1} as (select c.k, coalesce(m.v, c.v) as v from c{i} c left join m{i} m using (k))""")
    return f"""
with rows as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
kept as (
    select r, vec_id, [floor({factor} * x) for x in e] as v from rows
    where len(e) = {size} and not list_contains([x is null for x in e], true) and not list_contains([isfinite(x) for x in e], false)
), c0 as (
    select row_number() over (order by sha256('1:' || vec_id) nulls last, v) - 1 as k, v from kept qualify k < {k}
), {", ".join(steps)},
named as (select k, sha256(array_to_string([x::bigint for x in v], ',')) as centroid_sha256 from c{rounds})
select vec_id, k::int as cluster, best[1]::bigint as distance, sum(best[1]) over (partition by k)::bigint as cluster_inertia,
    sum(best[1]) over ()::bigint as inertia, centroid_sha256
from kept join n{rounds} using (r) join named on k = best[2]"""
