"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.llm.burst_trie import conversation_trie
from pairweave.llm.cap_filters import near_vectors
from pairweave.llm.decontaminate import find_leaks
from pairweave.llm.html_text import extract
from pairweave.llm.importance import resample
from pairweave.llm.language_id import fit as fit_language
from pairweave.llm.language_id import identify
from pairweave.llm.merkle_manifest import verified_manifest
from pairweave.llm.minmax_dedup import near_duplicates
from pairweave.llm.mixing import mix_sources
from pairweave.llm.token_store import tokenised
from pairweave.llm.toxicity import fit as fit_toxicity
from pairweave.llm.toxicity import toxicity
from pairweave.llm.url_vocabulary import SOFT, STRICT, judge_urls
from pairweave.llm.warc_store import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"


@_query(
    "op10_minmax_near_duplicates",
    rf"""
    with recursive words as (
        select doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) as w from documents
    ), runs as (
        select distinct doc_id, unnest(
            case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as run
        from words
    ), sizes as (select doc_id, count(*) as n from runs group by doc_id
    ), shared as (
        select x.doc_id as a, y.doc_id as b, count(*) as n
        from runs x join runs y on x.run = y.run and x.doc_id < y.doc_id group by all
    ), links as (
        select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
        where 100 * shared.n >= 80 * (p.n + q.n - shared.n)
    ), sides as (select a, b from links union all select b, a from links
    ), reach as (
        select a as id, b as other from sides
        union
        select r.id, s.b from reach r join sides s on s.a = r.other
    ), named as (select id, least(id, min(other)) as component_id from reach group by id)
    select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id,
           coalesce(c.component_id, d.doc_id) = d.doc_id as kept
    from documents d left join sizes s on s.doc_id = d.doc_id left join named c on c.id = d.doc_id
    """,
)
def op10(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), size=4)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op7_token_store")
def op7(spark, sf_dir):
    return tokenised(_table(spark, sf_dir, "documents"), public_tokenizer())


MIX = """
    sized as (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {words})) as size from {table}
    ), sources as (
        select source, count(*) as n, sum(size)::bigint as source_size,
               [3.0::double, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
        from sized group by source
    ), levels as (
        select *, 2.0::double * source_size as most,
               (1.5::double * sum(source_size) over ()
                - coalesce(sum(2.0::double * source_size) over (f rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (f rows between current row and unbounded following) as level
        from sources window f as (order by 2.0::double * source_size / weight, source nulls last)
    ), targets as (
        select source, source_size, most, weight,
               least(coalesce((select arg_min(l.level, l.most / l.weight) from levels l where l.level * l.weight <= l.most) * weight, most), most) as target
        from levels
    ), plan as (
        select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
               target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end) * source_size as words
        from targets
    ), counted as (
        select s.source, s.size, count(*)::double as k, any_value(p.words) as words
        from sized s join plan p on s.source is not distinct from p.source where s.size > 0 group by s.source, s.size
    ), larger as (
        select *, coalesce(sum(size * k) over (d rows between unbounded preceding and 1 preceding), 0) as above,
               sum(size::double * size * k) over (d rows between current row and unbounded following) as squares
        from counted window d as (partition by source order by size desc)
    ), factors as (
        select source, min(size) filter (where sure) as sure_from, coalesce(sum(size * k) filter (where sure), 0) as sure_words,
               sum(size::double * size * k) filter (where not sure) as open_squares
        from (select *, size * (words - above) >= squares and words > 0 as sure from larger) group by source
    ), ready as (
        select s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.words - coalesce(f.sure_words, 0) as rest,
               coalesce(s.size >= f.sure_from, false) as sure,
               least((p.words - coalesce(f.sure_words, 0)) / f.open_squares * s.size, 1.0::double) as chance,
               (('0x' || substr(md5('9:' || s.doc_id), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
        from sized s join plan p on s.source is not distinct from p.source
        left join factors f on s.source is not distinct from f.source
    ), ranked as (
        select *, sum(size) over (partition by source, not sure and rest > 0 and size > 0
                                  order by u * (1 - chance) / ((1 - u) * chance), doc_id rows unbounded preceding) as upto
        from ready
    ), mixed as (
        select doc_id, size::bigint as size, source_size, target,
               case when size = 0 then 0 else whole + (sure or (rest > 0 and upto - size / 2.0::double <= rest))::int end as copies
        from ranked
    )
"""


@_query(
    "op9_pareto_mixing",
    "with " + MIX.format(words=WORDS, table="documents")
    + "select doc_id, size, source_size, target, copies::bigint as copies, (copies * size)::bigint as taken from mixed",
)
def op9(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents"))


@_query(
    "op5_warc_store",
    """
    with payloads as (
        select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages
    ), digests as (
        select page_id, body, strlen(body) as n, array_to_string([
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (5 * (3 - k % 4))) & 31)::integer, 1)
            for k in range(32)], '') as digest
        from payloads
    ), firsts as (select *, min(page_id) over (partition by body) as first_id from digests)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
           case when page_id = first_id then 'response' else 'revisit' end as record_type,
           case when page_id = first_id then null else first_id end as refers_to
    from firsts
    """,
)
def op5(spark, sf_dir):
    return archived(_table(spark, sf_dir, "pages"))


@_query("op3_decontamination")
def op3(spark, sf_dir):
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def held_out() -> F.Column:
    """Documents that no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@_query("op6_toxicity")
def op6(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query(
    "op4_cap_filters",
    """
    with recursive able as (
        select vec_id, embedding::double[] as v from embeddings
        where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), sides as (
        select x.vec_id as a, y.vec_id as b from able x join able y
        on x.vec_id <> y.vec_id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.9
    ), reach as (
        select a as id, b as other from sides
        union
        select r.id, s.b from reach r join sides s on s.a = r.other
    ), named as (select id, least(id, min(other)) as component_id from reach group by id
    ), counted as (select a as id, count(*) as n from sides group by a)
    select e.vec_id, coalesce(c.n, 0)::bigint as n_links, coalesce(m.component_id, e.vec_id) as component_id,
           coalesce(m.component_id, e.vec_id) = e.vec_id as kept
    from embeddings e left join counted c on c.id = e.vec_id left join named m on m.id = e.vec_id
    """,
)
def op4(spark, sf_dir):
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op2_language_id")
def op2(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit_language(docs, F.col("doc_id").isNotNull() & ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query("op8_importance_resampling")
def op8(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out()).select("doc_id")
    found = resample(_table(spark, sf_dir, "documents"), good)
    return found.select("doc_id", held_out().alias("held_out"), "n_grams", "log_weight", "rank_value", "selected")


@_query("op1_html_text")
def op1(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"))


URL_RULES = [  # fixed values
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


@_query(
    "op11_url_vocabulary",
    rf"""
    with rules(verdict, host, path) as (values {_values(URL_RULES)}
    ), terms(term, kind) as (values {_values([(t, "strict") for t in STRICT] + [(t, "soft") for t in SOFT if t not in STRICT])}
    ), lowered as (
        select page_id, {LOWER.replace("text", "coalesce(url, '')", 1)} as whole,
               case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages
    ), cut as (
        select *, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^?#]*') as front from lowered
    ), parts as (
        select page_id, whole, {LOWER.replace("text", "raw", 1)} as host, front[length(raw) + 1:] as path from cut
    ), fitting as (
        select p.page_id, p.host, p.path, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict),
                                  length(r.host || r.path)) as best
        from (select distinct page_id, host, path from parts) p
        join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
        group by all
    ), words as (
        select row_number() over () as row, page_id, host, path,
               regexp_extract_all(whole, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as w, whole
        from parts
    ), hits as (
        select w.row, t.term, t.kind, case when contains(t.term, '-')
            then (len(regexp_extract_all('.' || whole || '.', '[^a-z0-9\x{{80}}-\x{{10FFFF}}]' || t.term || '[^a-z0-9\x{{80}}-\x{{10FFFF}}]')))
            else len(list_filter(w.w, lambda x: x = t.term)) end as n
        from words w join terms t on contains(w.whole, t.term)
    ), sums as (
        select row, sum(n) filter (where kind = 'strict') as strict, sum(n) filter (where kind = 'soft') as soft,
               count(*) filter (where kind = 'soft' and n > 0) as kinds
        from hits group by row
    )
    select w.page_id, w.host, w.path, f.best.rule as rule,
           coalesce(f.best.verdict, case when coalesce(s.strict, 0) > 0 or coalesce(s.kinds, 0) >= 2 then 'block' else 'allow' end) as verdict,
           coalesce(s.strict, 0)::bigint as n_strict, coalesce(s.soft, 0)::bigint as n_soft,
           coalesce(s.kinds, 0)::bigint as n_soft_terms
    from words w left join sums s on s.row = w.row
    left join fitting f on f.page_id is not distinct from w.page_id and f.host = w.host and f.path = w.path
    """,
)
def op11(spark, sf_dir):
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit."""
    bits = f"flatten(list_transform(range(length({text})), lambda i: [ascii(substr({text}, i + 1, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform({bits}, lambda b: b::bigint)), "
        f"lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    )


@_query(
    "op12_burst_trie",
    f"""
    with own as (
        select conv_id, list(struct_pack(r := r, x := x) order by turn nulls first, r, x) as turns
        from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)
        group by conv_id
    ), shared as (
        select conv_id, turns, conv_id - conv_id % 100 as base, {crc32_sql("conv_id::varchar")} % 6 as h from own
    ), whole as (
        select s.conv_id, list_concat(coalesce(b.turns[1:s.h], []), s.turns[s.h + 1:]) as turns
        from shared s left join own b on b.conv_id = s.base
    ), member as (
        select conv_id, turns, unnest(range(len(turns) + 1)) as depth from whole
    ), keyed as (
        select conv_id, depth, depth = len(turns) as ends, turns[1:depth] as prefix, turns[1:depth - 1] as up,
               coalesce(length(turns[depth].x), 0) as tokens
        from member
    ), nodes as (
        select depth, prefix, case when depth > 0 then any_value(up) end as up, min(conv_id) as conv_id, count(*) as n_convs,
               any_value(tokens) as tokens,
               sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
        from keyed group by depth, prefix
    ), childs as (select up, count(*) as n from nodes where depth > 0 group by up
    ), full_nodes as (
        select n.*, coalesce(c.n, 0) as n_children from nodes n left join childs c on c.up = n.prefix
    ), subtree as (
        select a.prefix, sum((b.n_children = 0)::int)::bigint as n_leaves, sum((b.n_convs - 1) * b.tokens)::bigint as saved_tokens
        from full_nodes b join keyed k on k.conv_id = b.conv_id and k.depth <= b.depth
        join full_nodes a on a.depth = k.depth and a.prefix = k.prefix
        group by a.prefix
    )
    select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    from full_nodes n join subtree s on s.prefix = n.prefix left join nodes p on p.prefix = n.up
    """,
)
def op12(spark, sf_dir):
    base = F.col("conv_id") - F.col("conv_id") % 100
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    return conversation_trie(_table(spark, sf_dir, "conversations"), base, shared)


def _field_sql(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar)::varchar || ':' || {column}::varchar end"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@_query(
    "op13_merkle_manifest",
    f"""
    with recursive rows as (
        select row_number() over () as row, doc_id, source, {_leaf_sql("text")} as leaf,
               case when {crc32_sql("doc_id::varchar")} % 5 = 0 then {_leaf_sql(f"({LOWER})")} end as other
        from documents
    ), leaves as (
        select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from rows
    ), trees as (
        select source, 0 as level, list(leaf order by pos) as nodes from leaves group by source
        union all
        select source, level + 1, list_transform(range((len(nodes) + 15) // 16), lambda r: sha256(array_to_string(nodes[16 * r + 1:16 * r + 16], '')))
        from trees where len(nodes) > 1
    ), subroots as (
        select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as pos from trees where len(nodes) = 1
    ), crowns as (
        select 0 as level, list(subroot order by pos) as nodes from subroots having count(*) > 0
        union all
        select level + 1, list_transform(range((len(nodes) + 15) // 16), lambda r: sha256(array_to_string(nodes[16 * r + 1:16 * r + 16], '')))
        from crowns where len(nodes) > 1
    ), root as (select nodes[1] as root from crowns where len(nodes) = 1
    ), steps as (
        select l.row, t.level, l.pos // (16 ** t.level)::bigint as place, t.nodes
        from leaves l join trees t on t.source is not distinct from l.source where len(t.nodes) > 1
        union all
        select l.row, 100 + c.level, s.pos // (16 ** c.level)::bigint, c.nodes
        from leaves l join subroots s on s.source is not distinct from l.source join crowns c on len(c.nodes) > 1
    ), sides as (
        select row, level, array_to_string(nodes[(place // 16) * 16 + 1:place], '') as l,
               array_to_string(nodes[place + 2:(place // 16) * 16 + 16], '') as r
        from steps
    ), paths as (
        select row, list(struct_pack(l := l, r := r) order by level) as path, string_agg(l || r, '' order by level) as flat
        from sides group by row
    ), folds as (
        select d.row, 0 as k, coalesce(d.other, d.leaf) as h, coalesce(p.path, []) as path from leaves d left join paths p using (row)
        union all
        select row, k + 1, sha256(path[k + 1].l || h || path[k + 1].r), path from folds where k < len(path)
    )
    select d.doc_id, d.leaf, s.subroot, root.root, sha256(coalesce(p.flat, '')) as proof_sha256,
           f.h as folded_root, f.h = root.root as verified
    from leaves d join subroots s on s.source is not distinct from d.source cross join root
    left join paths p on p.row = d.row join folds f on f.row = d.row and f.k = len(f.path)
    """,
)
def op13(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return verified_manifest(docs, tampered, F.translate("text", upper, small))
