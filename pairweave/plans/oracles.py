"""DuckDB SQL with the meaning of each registered query, on the same tables."""

from __future__ import annotations

from pairweave.operators.eval_pairs import SENSITIVITY_THRESHOLDS
from pairweave.plans.bindings import CLASS_PROBES, PROJECTION, PROJECTION_PROBES
from pairweave.schemas import SCORE_COLUMNS

M1, M2, M3 = SCORE_COLUMNS
N = "(select count(*) from embeddings)"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def packed(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: round(v * 1e6)::bigint::varchar), ',')"


def hexnum(digest: str, first: int = 1, digits: int = 8) -> str:
    return f"('0x' || substr({digest}, {first}, {digits}))::bigint"


def ratio(a: str, b: str) -> str:
    return f"(case when {b} = 0 then 0.0::double else ({a})::double / ({b}) end)"


def rate(a: str, b: str) -> str:
    return f"(case when {b} <> 0 then ({a})::double / ({b}) end)"


def rooted(v: str) -> str:
    return f"list_transform({v}, lambda x: sign(x) * sqrt(abs(x)))"


def absolute_similarity(a: str, b: str) -> str:
    size = lambda v: f"list_sum(list_transform({v}, lambda x: abs(x)))"
    return f"1.0 - list_sum(list_transform({a}, lambda x, i: abs(x - {b}[i]))) / ({size(a)} + {size(b)})"


def topk_cte(k: int, fn: str = "list_cosine_similarity", shape=lambda v: v) -> str:
    q, c = shape("(q.embedding::double[])"), shape("(c.embedding::double[])")
    return f"""
        select query_id, rank::int as rank, item_id, similarity from (
            select query_id, item_id, similarity,
                   row_number() over (partition by query_id order by similarity desc, item_id) as rank
            from (
                select q.vec_id as query_id, c.vec_id as item_id,
                       round({fn}({q}, {c}), 12) as similarity
                from embeddings q join embeddings c on q.vec_id <> c.vec_id
            )
        ) where rank <= {k}"""


def qn(seed: str, key: str) -> str:
    """The number behind a seeded pseudo-random choice."""
    return hexnum(f"md5('{seed}:' || {key})")


CTES: dict[str, str] = {
    "centers": """
        select label as cell, list(x order by place) as c from (
            select label, place, round(avg(x), 6) as x from (
                select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as place from embeddings
            ) group by label, place
        ) group by label""",
    "cell_order": """
        select vec_id, cell, row_number() over (partition by vec_id order by d, cell) as place from (
            select vec_id, cell, 0.5 * list_inner_product(c, c)
                   - list_inner_product(v, c) / sqrt(list_inner_product(v, v)) as d
            from (select vec_id, embedding::double[] as v from embeddings) cross join centers)""",
    "assigned": "select vec_id, cell from cell_order where place = 1",
    "walked": f"""
        select vec_id, cell from (
            select o.vec_id, o.cell, row_number() over w as r, coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0) as before
            from cell_order o join (select cell, count(*) as n from assigned group by cell) s using (cell)
            window w as (partition by o.vec_id order by o.place)
        ) where r <= {CLASS_PROBES} or before < 6""",
    "index_hits": """
        select query_id, rank::int as rank, item_id, similarity from (
            select *, row_number() over (partition by query_id order by similarity desc, item_id) as rank from (
                select w.vec_id as query_id, a.vec_id as item_id,
                       round(list_cosine_similarity(q.embedding::double[], i.embedding::double[]), 12) as similarity
                from walked w join assigned a on a.cell = w.cell and a.vec_id <> w.vec_id
                join embeddings q on q.vec_id = w.vec_id join embeddings i on i.vec_id = a.vec_id)
        ) where rank <= 5""",
    "normals": f"""
        select t, b, list({hexnum("md5('" + str(PROJECTION["seed"]) + ":' || t || ':' || b || ':' || j)")} / 4294967296.0::double - 0.5 order by j) as normal
        from range({PROJECTION["tables"]}) x(t), range({PROJECTION["bits"]}) y(b), (select unnest(range(len(embedding))) as j from embeddings limit 64) z
        group by t, b""",
    "away": """
        select vec_id, t, b, list_inner_product(embedding::double[], normal) / sqrt(list_inner_product(embedding::double[], embedding::double[])) as away
        from embeddings cross join normals""",
    "buckets": "select vec_id, t, sum((away >= 0)::int << b)::int as bucket, list(away order by b) as away from away group by vec_id, t",
    "visits": f"""
        select vec_id, t, xor(bucket, mask)::int as bucket from (
            select vec_id, t, bucket, mask, row_number() over (partition by vec_id, t order by cost, mask) as place from (
                select vec_id, t, bucket, mask::int as mask, round(list_sum(list_transform(away, lambda x, i: x * x * ((mask::int >> (i - 1)::int) & 1))), 12) as cost
                from buckets cross join range({1 << PROJECTION["bits"]}) m(mask))
        ) where place <= {PROJECTION_PROBES}""",
    "projected": """
        select query_id, rank::int as rank, item_id, similarity from (
            select *, row_number() over (partition by query_id order by similarity desc, item_id) as rank from (
                select distinct v.vec_id as query_id, x.vec_id as item_id,
                       round(list_cosine_similarity(q.embedding::double[], i.embedding::double[]), 12) as similarity
                from visits v join buckets x on x.t = v.t and x.bucket = v.bucket and x.vec_id <> v.vec_id
                join embeddings q on q.vec_id = v.vec_id join embeddings i on i.vec_id = x.vec_id)
        ) where rank <= 5""",
    "word_places": r"""
        select doc, unnest(w) as word, generate_subscripts(w, 1) as i from (
            select doc_id as doc, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B\x00]+'), lambda x: x <> '') as w from documents)""",
    "frequent_words": "select word from word_places group by word having count(*) >= 5",
    "word_pairs": """
        select a.word, b.word as context, count(*) as n
        from word_places a join word_places b on b.doc = a.doc and b.i in (a.i - 2, a.i - 1, a.i + 1, a.i + 2)
        where a.word in (from frequent_words) and b.word in (from frequent_words) group by all""",
    "word_ppmi": """
        select word, context, ppmi from (
            select word, context, ln(n::double * sum(n) over () / (sum(n) over (partition by word) * sum(n) over (partition by context)::double)) as ppmi from word_pairs
        ) where ppmi > 0""",
    "doc_terms": "select doc as doc_id, word as term, count(*) as tf from word_places group by all",
    "doc_sizes": """
        select d.doc_id, coalesce(s.n, 0) as n from documents d left join (select doc, count(*) as n from word_places group by doc) s on s.doc = d.doc_id""",
    "gains": """
        select t.doc_id, t.term, tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * s.n / avg_n)) as gain
        from doc_terms t join doc_sizes s using (doc_id) cross join (select avg(n) as avg_n from doc_sizes)""",
    "term_weights": """
        select term, ln(1 + (n_docs - count(*) + 0.5::double) / (count(*) + 0.5::double)) as weight
        from doc_terms cross join (select count(*) as n_docs from documents) group by term, n_docs""",
    "vpairs": f"""
        select a.vec_id as id, b.vec_id as b_id, a.embedding::double[] as va, b.embedding::double[] as vb,
               (a.label = b.label)::int as label
        from embeddings a join embeddings b on b.vec_id = (a.vec_id * 7 + 3) % {N}""",
    "scored": f"""
        select id, b_id, label,
               round(list_cosine_similarity({rooted('va')}, {rooted('vb')}), 6) as {M1},
               round({absolute_similarity('va', 'vb')}, 6) as {M2},
               round(list_cosine_similarity(va, vb), 6) as {M3}
        from vpairs""",
    "partly": f"""
        select id, label, {M1}, case when b_id in (select doc_id from labels) then {M2} end as {M2}, {M3}
        from scored""",
    "asked": "select conv_id, turn, text as sentence1 from conversations where role = 'user'",
    "replies": "select conv_id, turn, text as sentence2 from conversations where role = 'assistant'",
    "tpairs": """
        select (a.conv_id * 1000000 + a.turn) * 2 + (1 - l.label) as id, sentence1, sentence2, l.label::int as label
        from asked a cross join (values (1, 0), (0, 1)) l(label, shift)
        join replies r on r.conv_id = a.conv_id + l.shift and r.turn = a.turn + 1""",
    "hits": topk_cte(5),
    "hits10": topk_cte(10),
    "hits50": topk_cte(50),
    "rooted": topk_cte(5, shape=rooted),
    "cands": f"""
        select h.*, round(list_cosine_similarity({rooted('(q.embedding::double[])')}, {rooted('(c.embedding::double[])')}), 12) as second
        from hits10 h join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id""",
    "reranked": """
        select query_id, place::int as rank, item_id, similarity from (
            select *, row_number() over (partition by query_id order by second desc, rank) as place from cands
        ) where place <= 5""",
    "ahits": """
        select 'full' as approach, * from hits union all by name
        select 'rooted' as approach, * from rooted union all by name
        select 'reranked' as approach, * from reranked""",
    "qpos": """
        select vec_id as query_id, label, count(*) over (partition by label) - 1 as positives from embeddings""",
    "judged": """
        select h.*, (q.label = c.label)::int as rel from hits h
        join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id""",
    "fhits": """
        select * replace (row_number() over (partition by approach, query_id order by rank) as rank)
        from ahits where similarity >= 0.3""",
    "fjudged": """
        select h.*, (q.label = c.label)::int as rel from fhits h
        join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id""",
    "ajudged": """
        select h.*, (q.label = c.label)::int as rel from ahits h
        join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id""",
    "aqueries": """
        select q.query_id, q.positives, a.approach from qpos q
        cross join (values ('full'), ('rooted'), ('reranked')) a(approach)""",
    "long": f"""
        select '{M1}' as model, {M1} + 0.0 as score, label from scored union all
        select '{M2}', {M2} + 0.0, label from scored union all
        select '{M3}', {M3} + 0.0, label from scored""",
    "counted": """
        select model, score, sum(label)::bigint as pos, sum(1 - label)::bigint as neg from long group by all""",
    "curve": """
        select model, score as threshold, pos, neg,
               (sum(pos) over w)::bigint as tp, (sum(neg) over w)::bigint as fp,
               (sum(pos) over (partition by model))::bigint as P, (sum(neg) over (partition by model))::bigint as N
        from counted window w as (partition by model order by score desc)""",
    "best": """
        select model, max(P) as P, max(N) as N,
               sum(neg::hugeint * (2 * tp - pos)) as area,
               sum(pos::double / P * tp / (tp + fp)) as ap,
               max({'j': tp::hugeint * N - fp::hugeint * P, 't': threshold, 'tp': tp, 'fp': fp}) as b
        from curve group by model""",
    "summary": f"""
        select model, P, N, case when P * N <> 0 then area::double / (2.0 * P * N) end as auc,
               ap as average_precision,
               case when b.j <= 0 then 'infinity'::double else b.t end as best_threshold,
               case when b.j <= 0 then 0 else b.tp end as tp, case when b.j <= 0 then 0 else b.fp end as fp,
               P - case when b.j <= 0 then 0 else b.tp end as fn, N - case when b.j <= 0 then 0 else b.fp end as tn
        from best""",
    "thresholds": "select t.threshold from (values "
    + ", ".join(f"({t}::double)" for t in SENSITIVITY_THRESHOLDS)
    + ") t(threshold)",
    "confusion": """
        select model, threshold,
               count(*) filter (score >= threshold and label = 1) as tp,
               count(*) filter (score >= threshold and label = 0) as fp,
               count(*) filter (score < threshold and label = 1) as fn,
               count(*) filter (score < threshold and label = 0) as tn
        from long cross join thresholds group by all""",
    "sensitivity": f"""
        select model, threshold, {rate('tp + tn', '(tp + fp + fn + tn)')} as accuracy,
               coalesce({rate('tp', '(tp + fp)')}, 0.0) as precision, {rate('tp', '(tp + fn)')} as recall,
               {rate('tn', '(tn + fp)')} as specificity,
               coalesce({rate('2 * tp', '(2 * tp + fp + fn)')}, 0.0) as f1_score
        from confusion""",
    "words": r"""
        select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B\x00]+'), lambda w: w <> '')) as word
        from documents""",
    "rows": f"""
        select doc_id as global_index, lang, null::double as {M1}, n_chars::double as {M2}, null::double as {M3}
        from documents""",
    "updated": f"""
        select r.global_index, lang, coalesce(quality::double, {M1}) as {M1},
               coalesce(case when toxic = 1 then 0.5::double end, {M2}) as {M2}, {M3}
        from rows r left join labels l on l.doc_id = r.global_index""",
    "texts": "select distinct text from documents",
    "codes": "select text, list_transform(string_split(text, ''), lambda c: unicode(c)::bigint) as cs from texts",
    "grams": """
        select text, (cs[i] * 961 + cs[i + 1] * 31 + cs[i + 2]) % 8191 % 64 as slot
        from (select text, cs, unnest(range(1, len(cs) - 1)) as i from codes)""",
    "gcounts": "select text, slot, count(*) as n from grams group by all",
    "gvecs": """
        select text, list(coalesce(n, 0)::double order by s.slot) as v
        from (select t.text, r.slot from texts t cross join range(64) r(slot)) s
        left join gcounts using (text, slot) group by text""",
    "units": """
        select text, list_transform(v, lambda x: x / len_) as v
        from (select text, v, case when s = 0 then 1.0 else sqrt(s) end as len_
              from (select text, v, list_inner_product(v, v) as s from gvecs))""",
}

# Which fragments a fragment reads.
NEEDS = {
    "scored": ["vpairs"], "partly": ["vpairs", "scored"], "tpairs": ["asked", "replies"],
    "cands": ["hits10"], "reranked": ["hits10", "cands"], "ahits": ["hits", "rooted", "hits10", "cands", "reranked"],
    "fhits": ["hits", "rooted", "hits10", "cands", "reranked", "ahits"],
    "fjudged": ["hits", "rooted", "hits10", "cands", "reranked", "ahits", "fhits"],
    "judged": ["hits"], "ajudged": ["hits", "rooted", "hits10", "cands", "reranked", "ahits"], "aqueries": ["qpos"],
    "long": ["vpairs", "scored"], "counted": ["vpairs", "scored", "long"], "curve": ["vpairs", "scored", "long", "counted"],
    "best": ["vpairs", "scored", "long", "counted", "curve"],
    "summary": ["vpairs", "scored", "long", "counted", "curve", "best"],
    "confusion": ["vpairs", "scored", "long", "thresholds"],
    "sensitivity": ["vpairs", "scored", "long", "thresholds", "confusion"],
    "updated": ["rows"], "codes": ["texts"], "grams": ["texts", "codes"], "gcounts": ["texts", "codes", "grams"],
    "gvecs": ["texts", "codes", "grams", "gcounts"], "units": ["texts", "codes", "grams", "gcounts", "gvecs"],
}


def sql(body: str, *names: str, **own: str) -> str:
    """``body`` behind the named fragments and what they need."""
    ordered: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    parts = [f"{n} as materialized ({CTES[n]})" for n in ordered] + [f"{n} as ({text})" for n, text in own.items()]
    return (f"with {', '.join(parts)} " if parts else "") + body


def metrics_sql(queries: str, judged: str, by: str = "") -> str:
    """All per-query metrics as a select over a query table and judged hits."""
    keys = f"{by}query_id"
    return f"""
        select q.*, {ratio('coalesce(found, 0)', 'coalesce(retrieved, 0)')} as precision,
               {ratio('coalesce(found, 0)', 'positives')} as recall,
               case when {ratio('coalesce(found, 0)', 'coalesce(retrieved, 0)')} + {ratio('coalesce(found, 0)', 'positives')} = 0
                    then 0.0 else 2 * {ratio('coalesce(found, 0)', 'coalesce(retrieved, 0)')} * {ratio('coalesce(found, 0)', 'positives')}
                    / ({ratio('coalesce(found, 0)', 'coalesce(retrieved, 0)')} + {ratio('coalesce(found, 0)', 'positives')}) end as f1,
               coalesce(1.0 / first_found, 0.0)::double as mrr,
               coalesce(case when idcg = 0 then 0.0 else dcg / idcg end, 0.0)::double as ndcg
        from {queries} q left join (
            select {keys}, count(*) as retrieved, count(*) filter (rel > 0) as found,
                   min(rank) filter (rel > 0) as first_found,
                   sum(rel / log2(rank + 1.0)) as dcg, sum(rel / log2(ideal + 1.0)) as idcg
            from (select *, row_number() over (partition by {keys} order by rel desc, rank) as ideal from {judged})
            group by {keys}
        ) h using ({keys})"""


def averages(by: str = "") -> str:
    metrics = ", ".join(f"{r6(f'avg({m})')} as {m}" for m in ("precision", "recall", "f1", "mrr", "ndcg"))
    head = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return f"select {head}count(*) as queries, {metrics} from m{tail}"


ALL = ", ".join(f"{r6(m)} as {m}" for m in ("precision", "recall", "f1", "mrr", "ndcg"))
HIT_ROW = f"query_id, rank, item_id, {r6('similarity')} as similarity"
CHUNK = "(global_index // 100)"
RANK_DOCS = "row_number() over (order by md5('42:' || doc_id::varchar), doc_id) - 1"

ORACLES: dict[str, str] = {
    # scans, sources, sinks
    "load_pairs": sql("select id, sentence1, sentence2, label from tpairs", "tpairs"),
    "project_pairs": sql(
        "select id, label, md5(sentence1) as digest1, md5(sentence2) as digest2 from tpairs", "tpairs"
    ),
    "indexed_scan": sql(
        """select id, row_number() over (order by id) - 1 as global_index, 3 as empty_results,
            md5(concat_ws(chr(31), sentence1, sentence2)) as digest from tpairs""",
        "tpairs",
    ),
    "count_and_chunks": sql(
        f"""select {CHUNK} as chunk, min(global_index) as start_index, count(*) as rows,
            (select count(*) from rows) as total_rows,
            (select ceil(count(*) / 100.0)::bigint from rows) as total_chunks from rows group by 1""",
        "rows",
    ),
    "write_results": sql("select * from updated", "updated"),
    "eval_json_roundtrip": sql(
        """select q.approach, q.query_id, coalesce(string_agg(item_id::varchar, ',' order by rank), '') as items,
            coalesce(string_agg(round(similarity * 1e6)::bigint::varchar, ',' order by rank), '') as similarities,
            md5(coalesce(string_agg(coalesce(d.text, 'none'), chr(31) order by rank) filter (item_id is not null), '')) as sentences,
            any_value(a.precision) as precision, any_value(a.ndcg) as ndcg
            from aqueries q left join fhits h using (approach, query_id) left join documents d on d.doc_id = h.item_id
            join avgs a on a.approach = q.approach group by q.approach, q.query_id""",
        "fjudged", "aqueries",
        m=metrics_sql("aqueries", "fjudged", "approach, "),
        avgs=f"select approach, {r6('avg(precision)')} as precision, {r6('avg(ndcg)')} as ndcg from m group by approach",
    ),
    # projections, filters, sampling
    "valid_scored_pairs": sql(f"select * from partly where {M2} is not null", "partly"),
    "label_distribution": sql("select label, count(*) as n from scored group by label", "scored"),
    "row_lookup": "select doc_id as global_index, lang, source, n_chars, text from documents where doc_id = 42",
    "sample_queries": f"select doc_id, lang, text from (select *, {RANK_DOCS} as p from documents) where p < 100",
    "limit_rows": sql("select id, label, sentence1 from tpairs order by id limit 50", "tpairs"),
    "threshold_predict": sql(
        f"select id, label, ({M3} >= 0.1)::int as prediction, (({M3} >= 0.1)::int = label)::int as correct from scored",
        "scored",
    ),
    "threshold_accuracy": sql(
        f"""select count(*) as n, sum(({M3} >= 0.1)::int)::bigint as predicted,
            {r6(f'avg((({M3} >= 0.1)::int = label)::int)')} as accuracy from scored""",
        "scored",
    ),
    # vectors and embeddings
    "cosine_pairs": sql(f"select id, b_id, {r6('list_cosine_similarity(va, vb)')} as similarity from vpairs", "vpairs"),
    "dot_pairs": sql(f"select id, b_id, {r6('list_inner_product(va, vb)')} as similarity from vpairs", "vpairs"),
    "similarity_batch": sql(
        f"""select vec_id, {r6('list_cosine_similarity(embedding::double[], v)')} as similarity,
            {r6('list_inner_product(embedding::double[], v)')} as dot from embeddings cross join mean""",
        mean="""select list(x order by i) as v from (
            select i, avg(x) as x from (
                select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings
            ) group by i)""",
    ),
    "distance_to_similarity": sql(
        f"""select id, {r6('1.0 - (1.0 - list_cosine_similarity(va, vb))')} as from_cosine,
            {r6('1.0 - pow(list_distance(va, vb), 2) / 2.0')} as from_l2sq from vpairs""",
        "vpairs",
    ),
    "multi_model_scores": sql(
        f"""select *, '' as {M1}_error, case when {M2} is null then 'ValueError: missing vector' else '' end as {M2}_error,
            '' as {M3}_error from partly""",
        "partly",
    ),
    "score_pairs_job": sql(
        f"select *, case when {M2} is null then 'ValueError: missing vector' else '' end as reason from partly", "partly"
    ),
    "evaluate_pairs_files": sql(
        "select model, s.threshold, "
        + ", ".join(f"{r6(m)} as {m}" for m in ("accuracy", "precision", "recall", "specificity", "f1_score"))
        + f""", {r6('auc')} as auc, best_threshold, roc_points from sensitivity s join summary using (model)
            join (select model, count(*) + 1 as roc_points from curve group by model) using (model)""",
        "sensitivity", "summary",
    ),
    "embed_word_average": sql(
        f"""select d.doc_id, coalesce({packed('v.means')}, array_to_string(list_transform(range(64), lambda x: '0'), ',')) as vector
            from documents d left join (
                select doc_id, [{', '.join(f'sum(n * u[{i}]) / sum(n)' for i in range(1, 65))}] as means
                from tokens join vecs using (word) group by doc_id
            ) v using (doc_id)""",
        "words",
        tokens="select doc_id, word, count(*) as n from words group by all",
        unit="""select vec_id, list_transform(e, lambda x: x / len_) as u
                from (select vec_id, embedding::double[] as e,
                      sqrt(list_inner_product(embedding::double[], embedding::double[])) as len_ from embeddings)""",
        vocabulary=f"""select word, {hexnum('md5(word)')} % n as vec_id from (select distinct word from words)
            cross join (select count(*) as n from embeddings)""",
        vecs="select word, u from vocabulary join unit using (vec_id)",
    ),
    "word_cooccurrence": sql("select word, context, n::bigint as n from word_pairs", "word_places", "frequent_words", "word_pairs"),
    "word_information": sql(f"select word, context, {r6('ppmi')} as ppmi from word_ppmi", "word_places", "frequent_words", "word_pairs", "word_ppmi"),
    "embed_trained_words": sql(
        """select d.doc_id, k.doc is not null as known from documents d left join (
               select distinct doc from word_places where word in (select word from word_ppmi)) k on k.doc = d.doc_id""",
        "word_places", "frequent_words", "word_pairs", "word_ppmi",
    ),
    "embed_hashed_ngrams": sql(f"select sha256(text) as text_key, {packed('v')} as vector from units", "units"),
    "embed_reuse": sql(
        f"select doc_id, sha256(text) as text_key, {packed('v')} as vector from documents join units using (text)", "units"
    ),
    "pair_similarity": sql(
        f"""select conv_id * 1000000 + turn as id,
            {r6("coalesce(case when length(sentence1) > 0 and length(sentence2) > 0 then least(1.0, greatest(0.0, list_cosine_similarity(u1.v, u2.v))) end, 0.0)")} as similarity
            from (select a.*, r.sentence2 from asked a left join replies r on r.conv_id = a.conv_id and r.turn = a.turn + 1)
            left join units u1 on u1.text = sentence1 left join units u2 on u2.text = sentence2""",
        "asked", "replies", "units",
    ).replace("select distinct text from documents", "select distinct text from conversations"),
    # retrieval
    "exact_topk": sql(f"select {HIT_ROW} from hits", "hits"),
    "exact_topk_blocked": sql(f"select {HIT_ROW} from hits", "hits"),
    "batch_topk": sql(f"select {HIT_ROW} from dots", dots=topk_cte(7, "list_inner_product")),
    "vector_index_topk": sql(f"select {HIT_ROW} from index_hits", "centers", "cell_order", "assigned", "walked", "index_hits"),
    "vector_index_recall": sql(
        f"""select count(*) as exact_hits, count(i.item_id)::bigint as found_hits, {r6('count(i.item_id)::double / count(*)')} as recall
            from hits h left join index_hits i using (query_id, item_id)""",
        "hits", "centers", "cell_order", "assigned", "walked", "index_hits",
    ),
    "lexical_topk": sql(
        f"""select query_id, rank::int as rank, item_id, {r6('similarity')} as similarity from (
            select *, row_number() over (partition by query_id order by similarity desc, item_id) as rank from (
                select q.doc_id as query_id, g.doc_id as item_id, round(sum(q.tf * w.weight * g.gain), 9) as similarity
                from doc_terms q join term_weights w using (term) join gains g on g.term = q.term and g.doc_id <> q.doc_id
                where q.doc_id % 50 = 0 group by all)
        ) where rank <= 5""",
        "word_places", "doc_terms", "doc_sizes", "gains", "term_weights",
    ),
    "lexical_reranked_topk": sql(
        f"""select query_id, place::int as rank, old_rank::int as old_rank, item_id, {r6('similarity')} as similarity, {r6('score')} as score from (
            select *, row_number() over (partition by query_id order by score desc, old_rank) as place from (
                select h.query_id, h.rank as old_rank, h.item_id, h.similarity, round(coalesce(sum(q.tf * w.weight * g.gain), 0), 9) as score
                from hits10 h left join doc_terms q on q.doc_id = h.query_id left join term_weights w on w.term = q.term
                left join gains g on g.term = q.term and g.doc_id = h.item_id group by all)
        ) where place <= 5""",
        "word_places", "doc_terms", "doc_sizes", "gains", "term_weights", "hits10",
    ),
    "vector_index_trained": sql(
        f"select count(*) as exact_hits, true as recall_reached, {N} * least(5, {N} - 1)::bigint as n_hits from hits", "hits"
    ),
    "vector_projection_topk": sql(f"select {HIT_ROW} from projected", "normals", "away", "buckets", "visits", "projected"),
    "vector_projection_recall": sql(
        f"""select count(*) as exact_hits, count(i.item_id)::bigint as found_hits, {r6('count(i.item_id)::double / count(*)')} as recall
            from hits h left join projected i using (query_id, item_id)""",
        "hits", "normals", "away", "buckets", "visits", "projected",
    ),
    "vector_index_all_cells": sql(f"select {HIT_ROW} from hits", "hits"),
    "retrieval_with_text": sql(
        f"select {HIT_ROW}, coalesce(text, '') as sentence from hits left join documents on doc_id = item_id", "hits"
    ),
    "rerank_prompt": sql(
        """select query_id, n_candidates, length(prompt)::int as length, md5(prompt) as digest from (
            select l.query_id, n_candidates,
                   'Pick 3.' || chr(10) || chr(10) || 'Query: "' || coalesce(d.text, '') || '"' || chr(10) || chr(10)
                   || 'Candidates:' || chr(10) || numbered as prompt
            from listed l left join documents d on d.doc_id = l.query_id)""",
        "hits",
        listed="""select query_id, count(*) as n_candidates,
            string_agg(rank::varchar || '. ' || coalesce(text, ''), chr(10) order by rank) as numbered
            from hits left join documents on doc_id = item_id group by query_id""",
    ),
    "rerank_apply": sql(
        f"""select query_id, place::int as rank, old_rank::int as old_rank, item_id, {r6('similarity')} as similarity from (
                select query_id, unnest(ord) as old_rank, generate_subscripts(ord, 1) as place from orders_
            ) o join hits10 h on h.query_id = o.query_id and h.rank = o.old_rank""".replace(
            "select query_id, place", "select o.query_id, place", 1
        ),
        "hits10",
        answers=f"""select query_id, case when {hexnum('dg', 9, 2)} % 4 = 0 then 'none of them'
                    when {hexnum('dg', 9, 2)} % 4 = 1 then told || ' of 99999999999' else told end as response
            from (select vec_id as query_id, md5(vec_id::varchar) as dg,
                  'Closest: ' || ({hexnum('dg', 1, 2)} % 13) || ', ' || ({hexnum('dg', 3, 2)} % 13) || ' and '
                  || ({hexnum('dg', 5, 2)} % 13) || '; then ' || ({hexnum('dg', 7, 2)} % 13) as told from embeddings)
            where {hexnum('dg', 11, 2)} % 5 <> 0""",
        sizes="select query_id, count(*) as n from hits10 group by query_id",
        numbers=r"""select s.query_id, n, coalesce(list_filter(list_transform(
                regexp_extract_all(response, '\d+')[1:5], lambda x: try_cast(x as int)), lambda x: x between 1 and n), []) as raw
            from sizes s left join answers a using (query_id)""",
        picks="select query_id, n, list_filter(raw, lambda x, i: list_position(raw, x) = i) as p from numbers",
        orders_="""select query_id, list_concat(p, list_filter(range(1, n + 1), lambda x: not list_contains(p, x::int))::int[])[1:5] as ord
            from picks""",
    ),
    "reranked_topk": sql(f"select {HIT_ROW} from reranked", "reranked"),
    "apply_updates": sql("select * from updated", "updated"),
    "unprocessed_rows": sql(
        "select global_index, lang from rows where global_index not in (select doc_id from labels)", "rows"
    ),
    "already_done": sql("select global_index, lang from rows where global_index in (select doc_id from labels)", "rows"),
    "merge_results": sql("select * from updated", "updated"),
    # retrieval evaluation
    "eval_precision_recall_f1": sql(
        f"select query_id, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1 from m",
        "qpos", "judged", m=metrics_sql("qpos", "judged"),
    ),
    "eval_mrr": sql(f"select query_id, {r6('mrr')} as mrr from m", "qpos", "judged", m=metrics_sql("qpos", "judged")),
    "eval_ndcg": sql(f"select query_id, {r6('ndcg')} as ndcg from m", "qpos", "judged", m=metrics_sql("qpos", "judged")),
    "eval_macro": sql(averages(), "qpos", "judged", m=metrics_sql("qpos", "judged")),
    "eval_global_relevance": sql(
        f"select query_id, {ALL} from m",
        "hits",
        irel="select vec_id as item_id, coalesce(quality, 0) as rel from embeddings left join labels on doc_id = vec_id",
        jd="select h.*, rel from hits h join irel using (item_id)",
        qs="select vec_id as query_id, (select sum(rel) from irel) as positives from embeddings",
        m=metrics_sql("qs", "jd"),
    ),
    "eval_per_query_relevance": sql(
        f"select query_id, {ALL} from m",
        "asked", "replies", "units",
        best="""select query_id, item_id, rank from (
            select a.conv_id * 1000000 + a.turn as query_id, r.conv_id * 1000000 + r.turn as item_id,
                   row_number() over (partition by a.conv_id, a.turn
                       order by round(list_cosine_similarity(u.v, w.v), 12) desc, r.conv_id, r.turn) as rank
            from asked a join units u on u.text = a.sentence1 cross join replies r join units w on w.text = r.sentence2
        ) where rank <= 5""",
        qrels="""select a.conv_id * 1000000 + a.turn as query_id, r.conv_id * 1000000 + r.turn as item_id, l.rel
            from asked a cross join (values (1, 0), (0, 1)) l(rel, shift)
            join replies r on r.conv_id = a.conv_id + l.shift and r.turn = a.turn + 1""",
        jd="select h.*, coalesce(rel, 0) as rel from best h left join qrels using (query_id, item_id)",
        qs="""select conv_id * 1000000 + turn as query_id, coalesce(p, 0) as positives from asked
            left join (select query_id, sum(rel) as p from qrels group by 1) s on s.query_id = conv_id * 1000000 + turn""",
        m=metrics_sql("qs", "jd"),
    ).replace("select distinct text from documents", "select distinct text from conversations"),
    "hits_at_k": sql(
        "select count(*) as queries, "
        + ", ".join(
            r6(f"avg(case when label = 1 and best <= {k} then 1 else 0 end)") + f" as top_{k}_accuracy" for k in (1, 3, 5, 50)
        )
        + " from vpairs left join (select h.query_id, h.item_id, min(rank) as best from hits50 h group by all) "
        "on query_id = id and item_id = b_id",
        "vpairs", "hits50",
    ),
    "query_verdict": sql(
        f"""select count(*) as queries, count(*) filter (verdict = 'success') as successes,
            count(*) filter (verdict = 'true_negative') as true_negatives, count(*) filter (verdict = 'error') as errors,
            {r6("avg((verdict <> 'error')::int)")} as accuracy,
            {r6(ratio("count(*) filter (verdict = 'success' and label = 1)", "count(*) filter (label = 1)"))} as recall
            from v""",
        "vpairs", "hits",
        v="""select p.id, p.label, case when best > 0 then 'success' when p.label = 0 then 'true_negative' else 'error' end as verdict
            from vpairs p left join (
                select query_id, max(i.label) as best from hits join vpairs i on i.id = item_id group by query_id
            ) on query_id = p.id""",
    ),
    "topk_threshold_sweep": sql(
        f"""select k, threshold, retrieved, found, {r6(ratio('found', 'retrieved'))} as precision,
            {r6(ratio('found', '(select sum(positives) from qpos)'))} as recall from (
            select k, threshold, count(*) filter (rank <= k and similarity >= threshold) as retrieved,
                   count(*) filter (rank <= k and similarity >= threshold and q.label = c.label) as found
            from hits10 h join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id
            cross join (values (1), (3), (5), (10)) ks(k)
            cross join (values (0.2::double), (0.25::double), (0.3::double), (0.35::double)) ts(threshold)
            group by all)""",
        "hits10", "qpos",
    ),
    "grouped_eval": sql(
        averages('"group"'), "qpos", "judged",
        gq="""select *, 'class' || label as "group" from qpos""", m=metrics_sql("gq", "judged"),
    ),
    "graded_ndcg": sql(
        f"select query_id, {ALL} from m",
        "hits",
        jd="""select h.*, greatest(0, 3 - abs(q.label - c.label)) as rel from hits h
            join embeddings q on q.vec_id = h.query_id join embeddings c on c.vec_id = h.item_id""",
        sizes="select label, count(*) as n from embeddings group by label",
        qs="""select e.vec_id as query_id, (select sum(n) from sizes s where abs(s.label - e.label) <= 2) - 1 as positives
            from embeddings e""",
        m=metrics_sql("qs", "jd"),
    ),
    "graded_ndcg_corpus": sql(
        f"""select vec_id as query_id, {r6('coalesce(case when idcg = 0 then 0.0 else dcg / idcg end, 0.0)::double')} as ndcg
            from embeddings left join gained on query_id = vec_id left join ideals using (label)""",
        "hits",
        gained="""select query_id, sum(greatest(0, 3 - abs(q.label - c.label)) / log2(rank + 1.0)) as dcg from hits
            join embeddings q on q.vec_id = query_id join embeddings c on c.vec_id = item_id group by query_id""",
        sizes="select label, count(*) as n from embeddings group by label",
        others="""select q.label, greatest(0, 3 - abs(q.label - c.label)) as rel,
            unnest(range(least(5, c.n - (q.label = c.label)::int))) as copy from sizes q, sizes c""",
        ideals="""select label, sum(rel / log2(r + 1.0)) as idcg
            from (select label, rel, row_number() over (partition by label order by rel desc) as r from others)
            where r <= 5 group by label""",
    ),
    "evaluate_approaches": sql(
        averages("approach"), "ajudged", "aqueries", m=metrics_sql("aqueries", "ajudged", "approach, ")
    ),
    "compare_approaches": sql(
        "select metric, "
        + ", ".join(f"max(value) filter (approach = '{a}') as {a}" for a in ("full", "rooted", "reranked"))
        + " from (unpivot avgs on precision, recall, f1, mrr, ndcg into name metric value value) group by metric",
        "ajudged", "aqueries",
        m=metrics_sql("aqueries", "ajudged", "approach, "),
        avgs=averages("approach").replace("count(*) as queries, ", ""),
    ),
    "retrieval_experiment": sql(
        averages("approach"),
        "tpairs", "units",
        ranked="""select q.id as query_id, c.id as item_id, c.label as rel, row_number() over (partition by q.id
                order by round(list_cosine_similarity(qu.v, cu.v), 12) desc, c.id) as place
            from tpairs q join units qu on qu.text = q.sentence1
            cross join tpairs c join units cu on cu.text = c.sentence2""",
        placed="""select 'direct' as approach, query_id, place as rank, rel from ranked where place <= 2 union all
            select 'answered', query_id, case place when 3 then 1 else 2 end, rel from ranked where place in (3, 1)""",
        qs="""select id as query_id, approach, (select sum(label) from tpairs) as positives
            from tpairs cross join (values ('direct'), ('answered')) a(approach)""",
        m=metrics_sql("qs", "placed", "approach, "),
    ).replace("select distinct text from documents", "select distinct text from conversations"),
    "approach_timing": f"""
        select event_type as approach, {r6('coalesce(sum(value) filter (event_id % 10 = 0), 0.0)')} as indexing_time,
               {r6('avg(value) filter (event_id % 10 <> 0)')} as avg_retrieval_time,
               count(*) filter (event_id % 10 <> 0) as queries
        from events group by event_type""",
    # pair classification
    "roc_curve": sql(
        f"""select model, 'infinity'::double as threshold, case when max(N) <> 0 then 0.0::double end as fpr,
            case when max(P) <> 0 then 0.0::double end as tpr from curve group by model
            union all select model, threshold, {r6(rate('fp', 'N'))}, {r6(rate('tp', 'P'))} from curve""",
        "curve",
    ),
    "auc": sql(f"select model, {r6('auc')} as auc from summary", "summary"),
    "youden_threshold": sql(
        f"select model, best_threshold, {r6(rate('tp', 'P') + ' - ' + rate('fp', 'N'))} as youden_j from summary", "summary"
    ),
    "pr_curve": sql(
        f"""select distinct model, 'infinity'::double as threshold, 1.0::double as precision, 0.0::double as recall from curve
            union all select model, threshold, {r6(rate('tp', '(tp + fp)'))}, {r6(rate('tp', 'P'))} from curve""",
        "curve",
    ),
    "average_precision": sql(f"select model, {r6('average_precision')} as average_precision from summary", "summary"),
    "confusion_at_best": sql(
        f"""select model, best_threshold, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, tp::bigint as tp,
            {r6(rate('tp + tn', '(P + N)'))} as accuracy, {r6(rate('tn', 'N'))} as specificity,
            {r6(rate('tp', 'P'))} as sensitivity, {r6(rate('2 * tp', '(2 * tp + fp + fn)'))} as f1_score from summary""",
        "summary",
    ),
    "pair_eval_summary": sql(
        f"""select model, {r6('auc')} as auc, best_threshold, {r6(rate('tp + tn', '(P + N)'))} as accuracy,
            {r6(rate('tn', 'N'))} as specificity, {r6(rate('tp', 'P'))} as sensitivity,
            {r6(rate('2 * tp', '(2 * tp + fp + fn)'))} as f1_score, {r6('average_precision')} as average_precision
            from summary""",
        "summary",
    ),
    "threshold_sensitivity": sql(
        "select model, threshold, "
        + ", ".join(f"{r6(m)} as {m}" for m in ("accuracy", "precision", "recall", "specificity", "f1_score"))
        + " from sensitivity",
        "sensitivity",
    ),
    "threshold_bands": sql(
        """select s.model, s.best_threshold as balanced,
            (select threshold from sensitivity x where x.model = s.model and precision >= 0.09
             order by recall desc, threshold limit 1) as high_precision,
            (select threshold from sensitivity x where x.model = s.model and recall >= 0.2
             order by precision desc, threshold desc limit 1) as high_recall
            from summary s""",
        "summary", "sensitivity",
    ),
    # data quality and dataset jobs
    "validate_pairs": sql(
        """select c.check_name as "check", c.n as n_bad, case when c.n = 0 then 'ok'
            when c.check_name in ('invalid_label', 'missing_value') then 'error' else 'warning' end as status
            from (
                select 'invalid_label' as check_name, count(*) filter (not coalesce(label in (0, 1), false)) as n from tpairs union all
                select 'missing_value', (count(*) filter (id is null) + count(*) filter (sentence1 is null)
                    + count(*) filter (sentence2 is null) + count(*) filter (label is null))::bigint from tpairs union all
                select 'short_sentence', count(*) filter (length(sentence1) < 5 or length(sentence2) < 5) from tpairs union all
                select 'long_sentence', count(*) filter (length(sentence1) > 200 or length(sentence2) > 200) from tpairs union all
                select 'unbalanced_labels', (avg((label = 1)::int) not between 0.3 and 0.7)::bigint from tpairs
            ) c""",
        "tpairs",
    ),
    "stratified_split": """
        select doc_id, lang, case when p * 100 < n * 70 then 'train' when p * 100 < n * 85 then 'val' else 'test' end as split
        from (select doc_id, lang, count(*) over (partition by lang) as n,
              row_number() over (partition by lang order by md5('42:' || doc_id::varchar), doc_id) - 1 as p from documents)""",
    "dataset_metadata": sql(
        f"""select count(*) as size, 'id,sentence1,sentence2,label' as columns, count(*) filter (label = 1) as positives,
            count(*) filter (label = 0) as negatives, count(*) filter (not coalesce(label in (0, 1), false)) as other_labels,
            {r6('avg(label)')} as positive_ratio,
            sum({hexnum("sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(length({c}::varchar) || ':' || {c}, 'null')" for c in ("id", "sentence1", "sentence2", "label")) + "))", 1, 15)}::hugeint)::varchar as fingerprint,
            (select string_agg(e, ',' order by e) from (select coalesce(label::varchar, 'null') || ':' || count(*) as e from tpairs group by label)) as label_counts
            from tpairs""",
        "tpairs",
    ),
    "augment_pairs": sql(
        f"""select id, sentence1, sentence2, label from tpairs union all
            select mx + 1 + (copy - 1) * cnt + o as id,
                   case when side = 0 and len(w1) >= 4 then case g1 when ' ' then array_to_string(list_transform(w1, lambda w, i: case when i - 1 = word % len(w1) then w || '~' else w end), ' ') else array_to_string(list_transform(w1, lambda w, i: case when i - 1 = word % len(w1) then w || '~' else w end), '') end else sentence1 end,
                   case when side = 1 and len(w2) >= 4 then case g2 when ' ' then array_to_string(list_transform(w2, lambda w, i: case when i - 1 = word % len(w2) then w || '~' else w end), ' ') else array_to_string(list_transform(w2, lambda w, i: case when i - 1 = word % len(w2) then w || '~' else w end), '') end else sentence2 end,
                   label
            from (
                select *, case when contains(sentence1, ' ') then ' ' else '' end as g1, case when contains(sentence1, ' ') then string_split(sentence1, ' ') else string_split(sentence1, '') end as w1,
                       case when contains(sentence2, ' ') then ' ' else '' end as g2, case when contains(sentence2, ' ') then string_split(sentence2, ' ') else string_split(sentence2, '') end as w2,
                       {qn('42-side', "copy || ':' || id")} % 2 as side, {qn('42-word', "copy || ':' || id")} as word
                from (select *, row_number() over (order by id) - 1 as o, count(*) over () as cnt from tpairs where label = 1)
                cross join (values (1), (2)) c(copy) cross join (select max(id) as mx from tpairs)
            )""",
        "tpairs",
    ),
    "generate_pairs": sql(
        """select w.key as pair_key, w.domain as domain1, p.domain as domain2, w.label,
            md5(w.text) as digest1, md5(p.text) as digest2 from wanted w join located p on p.at = w.partner""",
        pool="""select distinct lang as domain, text, sha256(concat_ws(chr(31), lang, text)) as key from documents
            where lang is not null and text is not null""",
        placed="""select *, row_number() over (partition by domain order by md5('42:' || key), key) - 1 as place,
            count(*) over (partition by domain) as size, (select count(*) from pool) as total from pool""",
        starts="""select domain, sum(count(*)) over (order by substr(md5(domain), 1, 3), domain) - count(*) as start
            from pool group by domain""",
        located="select p.*, start, start + place as at from placed p join starts using (domain)",
        chosen=f"""select *, ({qn('42-label', 'key')} % 2)::int as label, {hexnum("md5('42-pick:' || key)", 1, 15)} as pick from located""",
        wanted="""select *, case when label = 1 then start + (place + 1 + pick % greatest(size - 1, 1)) % size
            else (start + size + pick % greatest(total - size, 1)) % total end as partner from chosen
            where case when label = 1 then size > 1 else total > size end""",
    ),
    "progress_report": sql(
        f"""select {CHUNK} as chunk, count(*) as rows, count(doc_id) as done,
            {r6('count(doc_id) * 100.0::double / count(*)')} as chunk_completion,
            {r6('(select count(*) from rows join labels on doc_id = global_index) * 100.0::double / (select count(*) from rows)')} as dataset_completion
            from rows left join labels on doc_id = global_index group by 1""",
        "rows",
    ),
    # streaming and models
    "resumable_scoring": sql(f"select id, label, {M1}, {M2}, {M3} from scored", "scored"),
    "stream_quality_metrics": sql(
        f"""select id // 100 as chunk, count(*) as rows, count({M2}) as scored,
            count(*) filter (({M2} >= 0.1)::int = label) as correct,
            {r6(f'count({M2}) * 100.0::double / count(*)')} as completion,
            {r6(rate(f'count(*) filter (({M2} >= 0.1)::int = label)', f'count({M2})'))} as accuracy
            from partly group by 1""",
        "partly",
    ),
    "model_map": sql(f"select id, b_id, {r6('list_cosine_similarity(va, vb)')} as score from vpairs", "vpairs"),
    "row_error_capture": f"""
        select a.vec_id as id, {r6('coalesce(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), -1.0)')} as score,
               case when b.vec_id is null then 'ValueError: missing vector' else '' end as error
        from embeddings a left join embeddings b on b.vec_id = a.vec_id * 3 + 1""",
}
ORACLES["chunked_results"] = sql(f"select *, {CHUNK} as chunk from updated", "updated")
ORACLES["resumable_scoring_rows"] = ORACLES["resumable_scoring"]
ORACLES["stream_quality_totals"] = ORACLES["stream_quality_metrics"]
ORACLES["pair_similarity_reusing"] = ORACLES["pair_similarity"]
ORACLES["eval_summary_csv"] = ORACLES["pair_eval_summary"]
