"""DuckDB oracle SQL fragments.

Independent re-statements of each operator in plain SQL over the driver's
views; used only to check the Spark plans.  Patterns come from the same fixed
values as the Spark side (DuckDB literals keep backslashes as written)."""

from __future__ import annotations

from grounded.functions import text as tf
from grounded.operators import context as ctxop
from grounded.operators import evaluate as ev
from grounded.operators import generate as gen
from grounded.operators import guard as gd
from grounded.operators import pii


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOKEN = lit(tf.TOKEN_PATTERN)
NL = "chr(10)"


def go_trim(x: str) -> str:
    return f"regexp_replace({x}, {lit(tf.TRIM_PATTERN)}, '', 'g')"


def strip_think(x: str) -> str:
    return go_trim(f"regexp_replace({x}, {lit(tf.THINK_PATTERN)}, '', 'g')")


def think_body(x: str) -> str:
    body = f"replace({go_trim(f'regexp_extract({x}, {lit(tf.THINK_PATTERN)}, 1)')}, {NL}, ' ')"
    return f"CASE WHEN regexp_matches({x}, {lit(tf.THINK_PATTERN)}) THEN {body} END"


def bucket(tok: str, dim: int) -> str:
    return f"((('0x' || substr(md5({tok}), 1, 8))::BIGINT) % {dim})"


def sparse_embed(src: str, key: str, text: str, dim: int = 768) -> str:
    """-> (key, b, n, w) over a relation ``src`` with columns key, text."""
    return f"""(SELECT {key}, b, n, ln(1 + n) / sqrt(sum(ln(1 + n) * ln(1 + n)) OVER (PARTITION BY {key})) AS w
  FROM (SELECT {key}, b, count(*) AS n FROM (
          SELECT {key}, {bucket('tok', dim)} AS b
          FROM (SELECT {key}, unnest(regexp_extract_all(lower(replace({text}, {NL}, ' ')), {TOKEN})) AS tok FROM {src}))
        GROUP BY {key}, b))"""


def token_windows(size: int = 512, overlap: int = 100) -> str:
    stride = size - overlap
    return f"""(SELECT doc_id, i, array_to_string(t[i * {stride} + 1 : i * {stride} + {size}], ' ') AS chunk
  FROM (SELECT doc_id, t, unnest(range(0, ceil(len(t) / {float(stride)})::BIGINT)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, {TOKEN}) AS t FROM documents) WHERE len(t) > 0))"""


def fill(template: str, **slots) -> str:
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        parts += [lit(pre), f"coalesce({slots[slot]}, '')"]
    parts.append(lit(rest))
    return "(" + " || ".join(parts) + ")"


def prompt(q: str, ctx: str, context_only: bool = False) -> str:
    with_ctx = fill(ctxop.CONTEXT_ONLY if context_only else ctxop.WITH_CONTEXT, context=ctx, question=q)
    return f"CASE WHEN coalesce({ctx}, '') = '' THEN {fill(ctxop.WITHOUT_CONTEXT, question=q)} ELSE {with_ctx} END"


def standin_completion(p: str) -> str:
    ctx = f"regexp_extract({p}, {lit(gen.CONTEXT_PATTERN)}, 1)"
    q = f"regexp_extract({p}, {lit(gen.QUESTION_PATTERN)}, 1)"
    body = f"CASE WHEN {ctx} <> '' THEN {ctx} WHEN {q} <> '' THEN {q} ELSE {p} END"
    return f"({lit(gen.THINK_OPEN)} || md5({p}) || {lit(gen.THINK_CLOSE)} || {NL} || {lit(gen.ANSWER_PREFIX)} || {body})"


def pii_any(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit(p)})" for _, p in tf.PII_PATTERNS) + ")"


def rule_verdict(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, {lit(gd.BLOCKED_WORDS_PATTERN)}) "
            f"THEN {lit(gd.UNSAFE_VIOLENT)} WHEN {pii_any(x)} THEN {lit(gd.UNSAFE_PRIVACY)} ELSE 'safe' END")


def passes(v: str) -> str:
    return f"coalesce({v} IS NOT DISTINCT FROM 'safe', false)"


def error_body(err: str) -> str:
    pre, post = __import__("grounded.operators.answer", fromlist=["x"]).ERROR_BODY.split("{reason}")
    return f"({lit(pre)} || {err} || {lit(post)})"


def html_to_text(x: str) -> str:
    e = x
    for pat in (tf.HTML_SCRIPT_PATTERN, tf.HTML_STYLE_PATTERN, tf.HTML_COMMENT_PATTERN, tf.HTML_TAG_PATTERN):
        e = f"regexp_replace({e}, {lit(pat)}, ' ', 'g')"
    for ent, rep in tf.HTML_ENTITIES:
        e = f"replace({e}, {lit(ent)}, {lit(rep)})"
    return go_trim(f"regexp_replace({e}, {lit(tf.WS_RUN_PATTERN)}, ' ', 'g')")


def chunks_with_id(size: int = 512, overlap: int = 100) -> str:
    return f"(SELECT doc_id * 16777216 + i AS cid, doc_id, i, chunk FROM {token_windows(size, overlap)})"


def chunk_search(q_src: str, q_key: str, q_text: str, k: int | None, threshold: float | None,
                 dim: int = 768, size: int = 512, overlap: int = 100) -> str:
    """questions x token-window chunks, sparse cosine; -> (qid, doc_id, i, chunk, score, rk)."""
    thr = f"WHERE s.score >= {threshold}" if threshold is not None else ""
    lim = f"WHERE rk <= {k}" if k else ""
    cw = chunks_with_id(size, overlap)
    return f"""(SELECT * FROM (
  SELECT s.qid, w.doc_id, w.i, w.chunk, s.score,
         row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, w.doc_id, w.i) AS rk
  FROM (SELECT q.{q_key} AS qid, c.cid, round(sum(q.w * c.w), 6) AS score
        FROM {sparse_embed(f'(SELECT {q_key}, {q_text} FROM {q_src})', q_key, q_text, dim)} q
        JOIN {sparse_embed(cw, 'cid', 'chunk', dim)} c ON q.b = c.b
        GROUP BY q.{q_key}, c.cid) s
  JOIN {cw} w ON s.cid = w.cid
  {thr}) {lim})"""


def cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def knn_self(k: int | None, threshold: float | None, cand_where: str = "true", src: str = "embeddings") -> str:
    """every vector as a question against the others -> (qid, vec_id, score, rk)."""
    thr = f"AND score >= {threshold}" if threshold is not None else ""
    lim = f"WHERE rk <= {k}" if k else ""
    return f"""(SELECT * FROM (
  SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
  FROM (SELECT a.vec_id AS qid, b.vec_id, {cos('a.embedding', 'b.embedding')} AS score
        FROM {src} a JOIN {src} b ON a.vec_id <> b.vec_id WHERE {cand_where.replace('@', 'b.')})
  WHERE score IS NOT NULL {thr}) {lim})"""


def ivf(nprobe: int, k: int = 10, threshold: float = 0.3, cand_where: str = "true") -> str:
    """pivots = the sqrt(n) rows of the smallest id hash; cell = best pivot (ties to the lower one)."""
    return f"""(WITH piv AS (SELECT cell, embedding FROM (
                    SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, embedding FROM embeddings)
                  WHERE cell < (SELECT ceil(sqrt(count(*))) FROM embeddings)),
     sim AS (SELECT e.vec_id, p.cell, {cos('e.embedding', 'p.embedding')} AS s FROM embeddings e, piv p),
     rnk AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS r FROM sim),
     cand AS (SELECT p.vec_id AS qid, a.vec_id FROM rnk p JOIN rnk a ON p.cell = a.cell
              WHERE p.r <= {nprobe} AND a.r = 1 AND a.vec_id <> p.vec_id),
     sc AS (SELECT c.qid, c.vec_id, {cos('q.embedding', 'v.embedding')} AS score
            FROM cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings v ON v.vec_id = c.vec_id WHERE {cand_where.replace('@', 'v.')})
SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
               FROM sc WHERE score >= {threshold}) WHERE rk <= {k})"""


def ivf_tree(nprobe: int, beam: int, k: int = 10, threshold: float = 0.3) -> str:
    """As ``ivf``, through two levels: the first sqrt(pivots) pivots are coarse, a leaf belongs to its best coarse one, and only
    leaves of a vector's ``beam`` best coarse pivots are compared with it."""
    return f"""(WITH piv AS (SELECT cell, embedding FROM (
                    SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, embedding FROM embeddings)
                  WHERE cell < (SELECT ceil(sqrt(count(*))) FROM embeddings)),
     top AS (SELECT cell AS g, embedding FROM piv WHERE cell < (SELECT ceil(sqrt(count(*))) FROM piv)),
     leaf AS (SELECT cell, embedding, g FROM (SELECT p.cell, p.embedding, t.g,
                row_number() OVER (PARTITION BY p.cell ORDER BY {cos('p.embedding', 't.embedding')} DESC, t.g) AS r FROM piv p, top t) WHERE r = 1),
     down AS (SELECT vec_id, embedding, g FROM (SELECT e.vec_id, e.embedding, t.g,
                row_number() OVER (PARTITION BY e.vec_id ORDER BY {cos('e.embedding', 't.embedding')} DESC, t.g) AS r FROM embeddings e, top t) WHERE r <= {beam}),
     rnk AS (SELECT d.vec_id, l.cell, row_number() OVER (PARTITION BY d.vec_id ORDER BY {cos('d.embedding', 'l.embedding')} DESC, l.cell) AS r
             FROM down d JOIN leaf l USING (g)),
     cand AS (SELECT p.vec_id AS qid, a.vec_id FROM rnk p JOIN rnk a ON p.cell = a.cell
              WHERE p.r <= {nprobe} AND a.r = 1 AND a.vec_id <> p.vec_id),
     sc AS (SELECT c.qid, c.vec_id, {cos('q.embedding', 'v.embedding')} AS score
            FROM cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings v ON v.vec_id = c.vec_id)
SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
               FROM sc WHERE score >= {threshold}) WHERE rk <= {k})"""


def quantized(candidates: int, k: int) -> str:
    q8 = "list_transform(embedding, x -> floor(x / sqrt(list_sum(list_transform(embedding, y -> y::DOUBLE * y::DOUBLE))) * 127.0 + 0.5))"
    q8 = q8.replace("x -> ", "lambda x: ").replace("y -> ", "lambda y: ")
    return f"""(WITH qv AS (SELECT vec_id, embedding, {q8} AS q FROM embeddings),
     coarse AS (SELECT a.vec_id AS qid, b.vec_id, list_dot_product(a.q, b.q) AS s
                FROM qv a JOIN qv b ON a.vec_id <> b.vec_id),
     cand AS (SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS r
                                       FROM coarse) WHERE r <= {candidates}),
     sc AS (SELECT c.qid, c.vec_id, {cos('q.embedding', 'v.embedding')} AS score
            FROM cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings v ON v.vec_id = c.vec_id)
SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
               FROM sc) WHERE rk <= {k})"""


def product_candidates(parts: int, words: int, rounds: int, n: int, dim: int = 64, scale: int = 1 << 16) -> str:
    """-> (qid, vec_id, r): the n best codes per vector; codebooks by rounds of assignment and mean, all in whole numbers."""
    w = dim // parts
    fixed = f"list_transform(embedding, lambda x: floor(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) * {scale}.0 + 0.5))"
    near = """SELECT vec_id, p, s, code, w FROM (SELECT s.vec_id, s.p, s.s, b.code, b.w, row_number() OVER (PARTITION BY s.vec_id, s.p
                ORDER BY list_dot_product(b.w, b.w) - 2 * list_dot_product(s.s, b.w), b.code) AS r FROM sub s JOIN b{0} b USING (p)) WHERE r = 1"""
    mean = ", ".join(f"floor(sum(s[{i}]) / count(*))" for i in range(1, w + 1))
    steps = "".join(f""" a{r} AS MATERIALIZED ({near.format(r)}),
     b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.code, coalesce(m.w, b{r}.w) AS w FROM b{r}
                LEFT JOIN (SELECT p, code, [{mean}] AS w FROM a{r} GROUP BY p, code) m USING (p, code)),""" for r in range(rounds))
    return f"""(WITH fx AS MATERIALIZED (SELECT vec_id, {fixed}::DOUBLE[] AS x FROM embeddings),
     sub AS MATERIALIZED (SELECT vec_id, p, x[p * {w} + 1 : p * {w} + {w}] AS s FROM fx, range({parts}) t(p)),
     b0 AS MATERIALIZED (SELECT p, code, s AS w FROM sub JOIN (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id::VARCHAR) - 1 AS code
                FROM fx) USING (vec_id) WHERE code < {words}),{steps}
     near AS ({near.format(rounds)}),
     dec AS MATERIALIZED (SELECT vec_id, flatten(list(w ORDER BY p)) AS y FROM near GROUP BY vec_id)
SELECT * FROM (SELECT a.vec_id AS qid, d.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.x, d.y) DESC, d.vec_id) AS r
               FROM fx a JOIN dec d ON a.vec_id <> d.vec_id) WHERE r <= {n})"""


def product(parts: int, words: int, rounds: int, candidates: int, k: int) -> str:
    return f"""(SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk
               FROM (SELECT c.qid, c.vec_id, {cos('q.embedding', 'v.embedding')} AS score FROM {product_candidates(parts, words, rounds, candidates)} c
                     JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings v ON v.vec_id = c.vec_id)) WHERE rk <= {k})"""


def pii_list(x: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({x}, {lit(p)}) THEN {lit(n)} END" for n, p in tf.PII_PATTERNS)
    return f"list_filter([{items}], lambda c: c IS NOT NULL)"


def label_verdict(toxic: str) -> str:
    return f"CASE WHEN {toxic} = 0 THEN 'safe' WHEN {toxic} = 1 THEN {lit(gd.UNSAFE_LABEL)} END"


def decode(body: str) -> str:
    """-> status, query for a request body (DuckDB JSON functions).  Invalid JSON
    is nulled first so no JSON function ever sees it."""
    j = f"(CASE WHEN json_valid({body}) THEN {body} END)"
    key = (f"CASE WHEN list_contains(json_keys({j}), 'query') THEN 'query' "
           f"ELSE list_filter(json_keys({j}), lambda k: lower(k) = 'query')[1] END")
    path = f"'$.\"' || ({key}) || '\"'"
    vtype = f"json_type({j}, {path})"
    obj = f"({j} IS NOT NULL AND json_type({j}) IN ('OBJECT', 'NULL'))"
    bad = f"(NOT coalesce({obj}, false) OR (({key}) IS NOT NULL AND {vtype} <> 'NULL' AND {vtype} <> 'VARCHAR'))"
    q = f"CASE WHEN ({key}) IS NULL OR {vtype} = 'NULL' THEN '' ELSE json_extract_string({j}, {path}) END"
    return f"CASE WHEN {bad} THEN 400 ELSE 200 END AS status, CASE WHEN NOT {bad} THEN {q} END AS query"


def bm25(k: int = 10, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""(WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), {TOKEN}) AS t FROM documents),
     stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM d),
     tf AS (SELECT doc_id, dl, term, count(*) AS tf
            FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, dl, term),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     q AS (SELECT DISTINCT item_id, term FROM
           (SELECT item_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS term FROM benchmark)),
     s AS (SELECT q.item_id, tf.doc_id,
                  round(sum(ln(1.0::DOUBLE + (stats.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))
                        * (tf.tf * ({k1}::DOUBLE + 1.0::DOUBLE)
                           / (tf.tf + {k1}::DOUBLE * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * tf.dl / stats.avgdl)))), 6) AS score
           FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term CROSS JOIN stats
           GROUP BY q.item_id, tf.doc_id)
SELECT item_id, doc_id, score, rk FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM s) WHERE rk <= {k})"""


def doc_search(k: int | None, threshold: float | None, dim: int = 768) -> str:
    thr = f"WHERE score >= {threshold}" if threshold is not None else ""
    lim = f"WHERE rk <= {k}" if k else ""
    return f"""(SELECT * FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk
  FROM (SELECT q.item_id AS qid, c.doc_id, round(sum(q.w * c.w), 6) AS score
        FROM {sparse_embed('benchmark', 'item_id', 'text', dim)} q
        JOIN {sparse_embed('documents', 'doc_id', 'text', dim)} c ON q.b = c.b
        GROUP BY q.item_id, c.doc_id) {thr}) {lim})"""


def hybrid(k: int = 10) -> str:
    return f"""(SELECT item_id, doc_id, score, rk FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk
  FROM (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rk)), 6) AS score FROM (
          SELECT item_id, doc_id, rk FROM {bm25()}
          UNION ALL SELECT qid, doc_id, rk FROM {doc_search(10, None)}) GROUP BY item_id, doc_id))
WHERE rk <= {k})"""


def bootstrap(modes: dict[str, str], replicates: int, k: int = 10) -> str:
    """Paired Poisson bootstrap of reciprocal rank and NDCG; ``modes``: name -> (item_id, doc_id, rk)."""
    ranked = " UNION ALL ".join(f"SELECT '{n}' AS mode, item_id, doc_id, rk FROM {q}" for n, q in modes.items())
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(modes))
    weight = " + ".join(f"(u >= {bound})::BIGINT" for bound in ev.POISSON_BOUNDS)
    return f"""(WITH ranked AS MATERIALIZED ({ranked}), gold AS MATERIALIZED {GOLD}, modes(no, mode) AS (VALUES {names}),
     gain AS (SELECT i AS rk, round(1000000 / log2(i + 1))::BIGINT AS g, round(1000000 * sum(1 / log2(i + 1)) OVER (ORDER BY i))::BIGINT AS ideal FROM range(1, {k + 1}) t(i)),
     q AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY item_id),
     hit AS (SELECT mode, item_id, min(rk) AS first, sum(g) AS dcg FROM ranked JOIN gold USING (item_id, doc_id) JOIN gain USING (rk) GROUP BY mode, item_id),
     per AS MATERIALIZED (SELECT q.item_id, no, m.mode, coalesce(floor(1000000 / first + 0.5), 0) AS rr, floor(coalesce(dcg, 0) * 1000000.0::DOUBLE / ideal + 0.5) AS ndcg
             FROM q CROSS JOIN modes m JOIN gain ON gain.rk = least(n_gold, {k}) LEFT JOIN hit ON hit.item_id = q.item_id AND hit.mode = m.mode),
     w AS MATERIALIZED (SELECT item_id, b, CASE WHEN b < 0 THEN 1 ELSE {weight} END AS w
           FROM (SELECT item_id, b, ('0x' || substr(md5(item_id || ':' || b), 1, 8))::BIGINT AS u FROM q, range(-1, {replicates}) t(b))),
     long AS (SELECT item_id, no, mode, 'rr' AS metric, rr AS x FROM per UNION ALL SELECT item_id, no, mode, 'ndcg', ndcg FROM per),
     s AS MATERIALIZED (SELECT b, no, mode, metric, sum(w * x) AS s, sum(w) AS n FROM long JOIN w USING (item_id) GROUP BY ALL),
     v AS (SELECT b, n, metric, mode, NULL AS against, s / (nullif(n, 0) * 1000000.0::DOUBLE) AS x FROM s
           UNION ALL SELECT a.b, a.n, a.metric, a.mode, o.mode, (a.s - o.s) / (nullif(a.n, 0) * 1000000.0::DOUBLE) FROM s a JOIN s o ON a.b = o.b AND a.metric = o.metric AND o.no < a.no)
SELECT metric, mode, against, max(CASE WHEN b < 0 THEN n END)::BIGINT AS n_items, round(max(CASE WHEN b < 0 THEN x END), 6) AS value,
       round(quantile_cont(CASE WHEN b >= 0 THEN x END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN b >= 0 THEN x END, 0.975), 6) AS high,
       count(*) FILTER (WHERE b >= 0 AND x > 0) AS n_above
FROM v GROUP BY metric, mode, against)"""


GOLD = "(SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0)"


def pii_regions(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """-> (key, start, stop, category, n_spans): checked spans, overlapping ones joined."""
    checks = {
        "EMAIL": "NOT regexp_matches(regexp_extract(m, '@(.*)$', 1), '\\.\\.|^[.]')",
        "CARD": """(CASE WHEN regexp_full_match(m, '[0-9]+') THEN length(m) BETWEEN 13 AND 19 ELSE length(regexp_replace(m, '[^0-9]', '', 'g')) = 16 END)
            AND list_sum(list_transform(string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), ''),
                lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END ELSE c::INT END)) % 10 = 0""",
        "PHONE": "regexp_full_match(m, '.*-[0-9]{4}')",
        "IP": """regexp_full_match(m, '[0-9]{1,3}(\\.[0-9]{1,3}){3}')
            AND list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(p) <= 3 THEN p::INT ELSE 999 END)) <= 255""",
        "SECRET": "true"}
    parts = " UNION ALL ".join(f"""
      SELECT {key}, {n} AS no, '{cat}' AS cat, stop - (CASE WHEN '{cat}' = 'SECRET' THEN length(regexp_extract(m, '[A-Za-z0-9_-]+$')) ELSE length(m) END) AS start, stop
      FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY {key} ORDER BY j ROWS UNBOUNDED PRECEDING)::INT AS stop
            FROM (SELECT {key}, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS j
                  FROM (SELECT {key}, regexp_extract_all({text}, {lit(pattern)}) AS ms, string_split_regex({text}, {lit(pattern)}) AS gaps FROM {src})))
      WHERE {checks[cat]}""" for n, (cat, pattern) in enumerate(pii.CANDIDATES, 1))
    return f"""(SELECT {key}, min(start)::INT AS start, max(stop)::INT AS stop, first(cat ORDER BY stop - start DESC, start, no) AS category, count(*)::INT AS n_spans
  FROM (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY start, stop DESC, no ROWS UNBOUNDED PRECEDING) AS region
        FROM (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY {key} ORDER BY start, stop DESC, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                             THEN 0 ELSE 1 END AS opens FROM ({parts})))
  GROUP BY {key}, region)"""
