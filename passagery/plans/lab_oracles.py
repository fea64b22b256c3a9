"""DuckDB statements equal to the laboratory's queries that SQL can express."""

from __future__ import annotations

from passagery.functions import text as T
from passagery.operators import feedback as FB
from passagery.operators.rerank import FEATURES
from passagery.plans.oracles import ASKED, CORPUS, ORACLES, bm25, identifier, lst, r6, re_, runs, streams, top, word

_RESULTS = f"{CORPUS}, {ASKED}, {bm25('asked', word('text'), 'corpus', 'key', word('content'))}"


def results(k: int) -> str:
    return f"WITH {_RESULTS}, res AS (SELECT r.qid, r.rank, r.key, r.score, a.text, c.content, c.file_name, c.heading_path FROM {top('scores', k)} r JOIN asked a USING (qid) JOIN corpus c USING (key))"


NORM = lambda c: f"lower(trim(replace(coalesce({c}, ''), '\\', '/')))"


def _terms(tokens: str, depth: int, weighted: bool, most: int, ci: bool) -> str:
    strong = "CASE WHEN regexp_matches(token, '[-_]') OR (upper(token) = token AND regexp_matches(token, '[A-Za-z]')) THEN 3 ELSE 1 END" if weighted else "1"
    return f"""{results(depth)}, toks AS (SELECT qid, rank, {tokens} AS t FROM res), ex AS (SELECT qid, rank, unnest(t) AS token, unnest(range(len(t))) AS pos FROM toks_),
  cnt AS (SELECT qid, lower(token) AS term, sum({strong}) AS n, arg_min(token, rank * 1000000 + pos) AS shown FROM ex WHERE length(lower(token)) >= 3 GROUP BY 1, 2),
  pick AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, length(term) DESC, term) AS place FROM cnt)""".replace(
        "toks AS (SELECT qid, rank,", "toks_ AS (SELECT qid, rank,"
    ) + f", got AS (SELECT qid, string_agg(shown, ' ' ORDER BY place) AS terms FROM pick WHERE place <= {most} GROUP BY qid)"


_FB = (
    f"list_filter({runs('content')}, lambda t: regexp_matches(t, '^(?:[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)+|[A-Za-z][A-Za-z0-9]{{2,}})$') "
    f"AND NOT list_contains({lst(T.STOP_FEEDBACK)}, lower(t)))"
)
ORACLES["prf_terms"] = _terms(_FB, 2, True, 8, True) + " SELECT qid, terms FROM got"
ORACLES["field_feedback_terms"] = _terms(identifier("content"), 2, False, 6, True) + " SELECT qid, terms FROM got"
ORACLES["expanded_queries"] = _terms(_FB, 1, True, 8, True) + " SELECT qid, trim(concat_ws(' ', text, coalesce(terms, ''))) AS expanded FROM asked LEFT JOIN got USING (qid)"
_OV = (
    "list_distinct(list_filter(list_transform(list_filter({}, lambda t: regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9_-]*$')), lambda t: lower(t)), "
    f"lambda t: length(t) > 1 AND NOT list_contains({lst(T.STOP_OVERLAP)}, t)))"
)
ORACLES["lexical_overlap_boost"] = f"""{results(10)}, o AS (SELECT qid, key, score, {_OV.format(runs('text'))} AS q, {_OV.format(runs('content'))} AS c FROM res)
  SELECT qid, key, {r6("score + 0.2::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_intersect(q, c))::DOUBLE / len(q) ELSE 0 END")} AS score FROM o"""
_INTENT = f"(?:{FB.DEFINITION})"
ORACLES["intent_boost"] = f"""{results(10)}, o AS (SELECT qid, key, score, text, file_name, coalesce(content, '') AS content,
    list_filter({runs('text')}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9_-]{{1,9}}$') AND upper(t) = t AND regexp_matches(t, '[A-Z]')) AS ac FROM res)
  SELECT qid, key, {r6(f"score + len(list_filter(ac, lambda a: regexp_matches(content, {re_('(?i)' + FB.WORD_START)} || a || {re_(FB.WORD_END)}))) * CASE WHEN regexp_matches(lower(coalesce(file_name, '')), {re_(FB.GLOSSARY)}) THEN CASE WHEN regexp_matches(lower(coalesce(text, '')), {re_(FB.WORD_START + _INTENT + FB.WORD_END)}) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.15::DOUBLE END")} AS score FROM o"""
ORACLES["context_format"] = f"""{results(3)} SELECT qid, sha256(string_agg('--- Source [' || rank || ']: ' || r.file_name || ' (Chunk ' || c.chunk_index || ') ---' || chr(10) || r.content || chr(10), chr(10) ORDER BY rank)) AS context_hash
  FROM res r JOIN corpus c USING (key) GROUP BY qid"""
ORACLES["answer_sources"] = f"{results(3)} SELECT a.qid, count(r.key) AS sources, arg_min(r.file_name, r.rank) AS first_source FROM asked a LEFT JOIN res r USING (qid) GROUP BY a.qid"
ORACLES["ensemble_modes"] = f"""WITH {streams('dense', 'sparse', 'late')}, b AS (SELECT qid, key, max(round(norm, 9)) AS score FROM normed GROUP BY ALL)
  SELECT qid, key, rank, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM b) WHERE rank <= 10"""
ORACLES["resolved_hits"] = f"""WITH {CORPUS}, t AS (SELECT content, min(key) AS first FROM corpus GROUP BY content),
  h AS (SELECT CASE WHEN length(content) % 3 = 0 THEN first ELSE key END AS key FROM corpus JOIN t USING (content)) SELECT key, count(*) AS hits, 0.75::DOUBLE AS score FROM h GROUP BY key"""
_PICK = "SELECT qid, rank, key, {} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {}) AS rank FROM {}) WHERE rank <= 5"
ORACLES["profile_default"] = f"""{results(20)}, n AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM res),
  f AS (SELECT qid, key, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS score, {_OV.format(runs('text'))} AS q, {_OV.format(runs('content'))} AS c FROM n),
  b AS (SELECT qid, key, score + 0.2::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_intersect(q, c))::DOUBLE / len(q) ELSE 0 END AS score FROM f)
  """ + _PICK.format(r6("score"), "key", "b")
ORACLES["profile_fields"] = ORACLES["field_bm25"].rpartition("SELECT qid, rank, key")[0] + f""", cand AS (SELECT * FROM {top('summed', 50)}),
  n AS (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM cand),
  g AS (SELECT qid, key, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS score, file_name || chr(1) || coalesce(heading_path, '') AS section FROM n JOIN corpus USING (key)),
  best AS (SELECT qid, section, max(score) AS best FROM g GROUP BY ALL),
  bonus AS (SELECT qid, section, (count(*) OVER (PARTITION BY qid) - (row_number() OVER (PARTITION BY qid ORDER BY round(best, 9) DESC, section) - 1))::DOUBLE
    / greatest(1, count(*) OVER (PARTITION BY qid)) * 0.08::DOUBLE AS bonus FROM best),
  boosted AS (SELECT qid, key, score + bonus AS score FROM g JOIN bonus USING (qid, section)) """ + _PICK.format(r6("score"), "key", "boosted")
ORACLES["profile_corpus"] = ORACLES["corpus_profile_bm25"].replace(" AS norm FROM", " AS score FROM")
ORACLES["case_label_rows"] = f"""WITH l AS (SELECT case_no, label_id AS label, max(coalesce(gain, 1.0)) AS gain FROM case_labels WHERE kind = 'span' AND label_id IS NOT NULL AND case_no IS NOT NULL GROUP BY 1, 2)
  SELECT case_no::VARCHAR AS "case", 'span' AS kind, label, {NORM('document_id')} AS doc, span_start::BIGINT AS start, span_end::BIGINT AS "end", gain FROM l JOIN spans ON span_id = label
  WHERE {NORM('document_id')} <> '' AND span_start >= 0 AND span_start < span_end AND gain > 0"""
ORACLES["documents_round_trip"] = "SELECT id, count(*) AS n, min(sha256(content)) AS content_hash, max(page_number)::BIGINT AS page FROM documents_in GROUP BY id"
ORACLES["catalog_terms"] = ORACLES["corpus_bm25_stats"]
ORACLES["cached_search"] = f"WITH {_RESULTS} SELECT qid, rank, key, {r6('score')} AS score FROM {top('scores', 3)}"
ORACLES["streamed_events"] = f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"
_LT = (
    "list_distinct(list_filter(list_transform(list_filter({}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$')), lambda t: lower(t)), "
    f"lambda t: NOT list_contains({lst(T.STOP_LTR)}, t)))"
)
_MK = "list_filter({}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$') AND (regexp_matches(t, '[-_]') OR (upper(t) = t AND regexp_matches(t, '[A-Z]'))))"
_SH = lambda part, own: f"CASE WHEN len({own}) > 0 THEN len(list_intersect({own}, {part}))::DOUBLE / len({own}) ELSE 0.0::DOUBLE END"
_LTR = {f: "0.0::DOUBLE" for f in FEATURES} | {
    "exact_token_overlap": r6(_SH("c", "q")), "query_token_count": "len(q)::DOUBLE", "chunk_token_count": "len(c)::DOUBLE", "identifier_signal": "len(mc)::DOUBLE",
    "title_lexical_overlap": r6(_SH("ti", "q")), "heading_lexical_overlap": r6(_SH("h", "q")),
    "section_depth": "CASE WHEN coalesce(heading_path, '') <> '' THEN len(string_split(heading_path, ' > ')) ELSE 0 END::DOUBLE",
    "source_char_length": "length(coalesce(content, ''))::DOUBLE", "identifier_overlap": r6(_SH("ic", "iq")),
    "bm25_rank": "rank::DOUBLE", "bm25_score": r6("score"), "sparse_rank": "rank::DOUBLE", "sparse_score": r6("score"),
    "stream_count": "1.0::DOUBLE", "stream_presence": "1.0::DOUBLE", "rank_agreement": "1.0::DOUBLE",
}
_LTR_ROW = ", ".join(f"{v} AS {k}" for k, v in _LTR.items())
ORACLES["ltr_features"] = f"""{results(10)}, f AS (SELECT qid, key, rank, score, content, heading_path, {_LT.format(runs('text'))} AS q, {_LT.format(runs('content'))} AS c,
    {_LT.format(runs('heading_path'))} AS h, {_LT.format(runs("string_split(coalesce(heading_path, ''), ' > ')[1]"))} AS ti, {_MK.format(runs('content'))} AS mc, {_MK.format(runs('text'))} AS mq FROM res),
  g AS (SELECT *, list_distinct(list_transform(mc, lambda t: lower(t))) AS ic, list_distinct(list_transform(mq, lambda t: lower(t))) AS iq FROM f)
  SELECT qid, key, {_LTR_ROW} FROM g"""
ORACLES["rank_agreement"] = f"""WITH {streams()}, s AS (SELECT qid, stream, list(key) AS keys FROM streams WHERE rank <= 10 GROUP BY ALL)
  SELECT a.qid, {r6("len(list_intersect(a.keys, b.keys))::DOUBLE / len(list_distinct(list_concat(a.keys, b.keys)))")} AS overlap FROM s a JOIN s b ON a.qid = b.qid AND a.stream = 'dense' AND b.stream = 'sparse'"""

_DIV = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(content, '')), {re_(T.WORD)}), lambda t: length(t) > 2))"


def _mmr(picks: int) -> str:
    """Greedy picks, one relation each."""
    out = f"""{results(20)}, r AS (SELECT qid, key, rank, score, {_DIV} AS t, count(*) OVER (PARTITION BY qid) AS n,
    min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM res),
  rel AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END AS rel FROM r),
  sim AS (SELECT a.qid, a.key AS a, b.key AS b, CASE WHEN len(a.t) + len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0::DOUBLE END AS s
    FROM rel a JOIN rel b ON a.qid = b.qid WHERE a.n > {picks}),
  p1 AS (SELECT qid, key, 1 AS place FROM rel WHERE rank = 1 AND n > {picks})"""
    for i in range(2, picks + 1):
        out += f""", v{i} AS (SELECT r.qid, r.key, row_number() OVER (PARTITION BY r.qid ORDER BY 0.7::DOUBLE * any_value(r.rel) - (1 - 0.7::DOUBLE) * max(s.s) DESC, any_value(r.rank)) AS n
    FROM rel r JOIN p{i - 1} p ON p.qid = r.qid JOIN sim s ON s.qid = r.qid AND s.a = r.key AND s.b = p.key
    WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} x WHERE x.qid = r.qid AND x.key = r.key) GROUP BY r.qid, r.key),
  p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT qid, key, {i} FROM v{i} WHERE n = 1)"""
    return out + f""" SELECT p.qid, place::BIGINT AS place, p.key, {r6('score')} AS score FROM p{picks} p JOIN rel USING (qid, key)
  UNION ALL SELECT qid, rank::BIGINT, key, {r6('score')} FROM rel WHERE n <= {picks}"""


ORACLES["mmr_select"] = _mmr(5)

_EVAL = f"""{CORPUS}, cases AS (SELECT DISTINCT 'c' || case_no AS "case", split_name AS split, category, question AS q FROM benchmark_cases
    WHERE split_name IN ('dev', 'test') AND case_no IS NOT NULL AND question IS NOT NULL
    UNION SELECT 's' || span_id, 'known', 'known_item', heading FROM spans WHERE span_id IS NOT NULL AND heading IS NOT NULL),
  ev AS (SELECT "case" AS qid, q FROM cases), {bm25('ev', word('q'), 'corpus', 'key', word('content'))},
  deep AS (SELECT r.qid AS "case", r.rank, r.key, {NORM('c.file_name')} AS name, {NORM('c.file_path')} AS path, c.source_char_start AS s, c.source_char_end AS e, c.chunk_id, c.chunk_index,
    {NORM('c.chunk_id')} AS id, list_distinct([{NORM('c.chunk_id')}, {NORM('c.file_name')} || '::' || c.chunk_index, {NORM('c.file_path')} || '::' || c.chunk_index]) AS aliases
    FROM {top('scores', 20)} r JOIN corpus c USING (key)),
  res AS (SELECT * FROM deep WHERE rank <= 5),
  labels AS (SELECT 'c' || l.case_no AS "case", l.label, l.gain, {NORM('s.document_id')} AS doc, s.span_start AS s, s.span_end AS e FROM (SELECT case_no, label_id AS label, max(coalesce(gain, 1.0)) AS gain
    FROM case_labels WHERE kind = 'span' AND label_id IS NOT NULL AND case_no IS NOT NULL GROUP BY 1, 2) l JOIN spans s ON s.span_id = l.label
    UNION ALL SELECT 's' || span_id, span_id, 1.0::DOUBLE, {NORM('document_id')}, span_start, span_end FROM spans WHERE heading_level <= 2 AND span_id IS NOT NULL AND heading IS NOT NULL),
  dmatches AS (SELECT DISTINCT r."case", r.rank, l.label, l.gain FROM deep r JOIN labels l ON r."case" = l."case" AND l.doc <> ''
    AND (r.name = l.doc OR r.path = l.doc OR ends_with(r.name, '/' || l.doc) OR ends_with(r.path, '/' || l.doc)) AND greatest(r.s, l.s) < least(r.e, l.e)
    AND r.s IS NOT NULL AND r.e IS NOT NULL AND l.s IS NOT NULL AND l.e IS NOT NULL),
  smatches AS (SELECT * FROM dmatches WHERE rank <= 5),
  chunklab AS (SELECT DISTINCT 's' || s.span_id AS "case", {NORM('c.file_name')} || '::' || c.chunk_index AS label, 1.0::DOUBLE AS gain, c.chunk_index AS ordinal FROM spans s JOIN corpus c
    ON {NORM('c.file_name')} = {NORM('s.document_id')} AND c.source_char_start <= s.span_start AND s.span_start < c.source_char_end
    WHERE s.heading_level > 2 AND s.span_id IS NOT NULL AND s.heading IS NOT NULL),
  amatches AS (SELECT "case", rank, label, gain FROM (SELECT r."case", r.rank, l.label, l.gain, row_number() OVER (PARTITION BY r."case", r.rank ORDER BY l.ordinal, l.label) AS n
    FROM res r JOIN chunklab l ON r."case" = l."case" AND list_contains(r.aliases, l.label)) WHERE n = 1),
  srclab AS (SELECT DISTINCT 'c' || case_no AS "case", {NORM('document_id')} AS source FROM case_labels WHERE {NORM('document_id')} <> '' AND case_no IS NOT NULL),
  srcmatches AS (SELECT DISTINCT r."case", r.rank FROM res r JOIN srclab l ON r."case" = l."case" AND (contains(r.name, l.source) OR contains(r.path, l.source)
    OR string_split(l.source, '/')[-1] <> '' AND string_split(l.source, '/')[-1] IN (string_split(r.name, '/')[-1], string_split(r.path, '/')[-1]))),
  alllab AS (SELECT "case", label, gain FROM labels UNION ALL SELECT "case", label, gain FROM chunklab WHERE "case" NOT IN (SELECT "case" FROM labels)),
  matches AS (SELECT "case", rank, label, gain FROM smatches UNION ALL SELECT * FROM amatches WHERE "case" NOT IN (SELECT "case" FROM labels)),
  gains AS (SELECT "case", rank, 'span' AS kind, min(label) AS label, max(gain) AS gain FROM smatches GROUP BY 1, 2
    UNION ALL SELECT "case", rank, 'chunk', label, gain FROM amatches WHERE "case" NOT IN (SELECT "case" FROM labels)
    UNION ALL SELECT "case", rank, 'source', 'source', 1.0 FROM srcmatches WHERE "case" NOT IN (SELECT "case" FROM alllab))"""


def _metric_ctes(once: bool, k: int = 5, tag: str = "") -> str:
    first = "SELECT \"case\", label, min(rank) AS rank, max(gain) AS gain FROM matches WHERE rank <= {k} GROUP BY 1, 2" if once else "SELECT * FROM matches WHERE rank <= {k}"
    return f"""ideal{tag} AS (SELECT "case", sum(CASE WHEN n <= {k} THEN (pow(2.0::DOUBLE, gain) - 1) / log2(n + 1.0::DOUBLE) ELSE 0 END) AS idcg, count(*) AS relevant FROM (
      SELECT "case", label, gain, row_number() OVER (PARTITION BY "case" ORDER BY gain DESC, label) AS n FROM (SELECT "case", label, max(gain) AS gain FROM alllab GROUP BY 1, 2)) GROUP BY "case"),
  first{tag} AS ({first.format(k=k)}), per{tag} AS (SELECT "case", rank, max(gain) AS gain FROM first{tag} GROUP BY 1, 2),
  dcg{tag} AS (SELECT "case", sum((pow(2.0::DOUBLE, gain) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg, min(rank) AS first, count(*) AS hits FROM per{tag} GROUP BY 1),
  found{tag} AS (SELECT "case", count(DISTINCT label) AS found FROM first{tag} GROUP BY 1),
  srcm{tag} AS (SELECT "case", count(*) AS hits, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) AS dcg FROM srcmatches WHERE rank <= {k} GROUP BY 1),
  m{tag} AS (SELECT c."case", coalesce(found::DOUBLE / relevant, 0) AS recall, coalesce(hits::DOUBLE / {k}, 0) AS precision, coalesce(1.0::DOUBLE / first, 0) AS mrr,
    coalesce(dcg / nullif(idcg, 0), 0) AS ndcg FROM (SELECT DISTINCT "case" FROM cases WHERE "case" IN (SELECT "case" FROM alllab)) c LEFT JOIN ideal{tag} USING ("case") LEFT JOIN dcg{tag} USING ("case")
    LEFT JOIN found{tag} USING ("case")
    UNION ALL SELECT c."case", CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END, coalesce(hits::DOUBLE / {k}, 0), coalesce(1.0::DOUBLE / first, 0),
    coalesce(dcg / list_sum(list_transform(range(1, hits + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 0)
    FROM (SELECT DISTINCT "case" FROM cases WHERE "case" NOT IN (SELECT "case" FROM alllab)) c LEFT JOIN srcm{tag} USING ("case"))"""


_M = ", ".join(f"{r6(c)} AS {c}" for c in ("recall", "precision", "mrr", "ndcg"))
ORACLES["span_overlap_matches"] = f'WITH {_EVAL} SELECT "case", rank, label, gain FROM smatches'
ORACLES["case_metrics"] = f'WITH {_EVAL}, {_metric_ctes(True)} SELECT "case", {_M} FROM m'
ORACLES["case_metrics_repeated"] = f'WITH {_EVAL}, {_metric_ctes(False)} SELECT "case", {_M} FROM m'
ORACLES["metrics_by_category"] = f"""WITH {_EVAL}, {_metric_ctes(True)}, j AS (SELECT m.*, coalesce(category, 'uncategorized') AS category, coalesce(split, 'uncategorized') AS split FROM m JOIN cases USING ("case"))
  SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS level, coalesce(category, split, 'all') AS name,
    round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, count(*) AS cases FROM j GROUP BY GROUPING SETS ((), (category), (split))"""
ORACLES["source_matches"] = f'WITH {_EVAL} SELECT "case", min(rank) AS first_rank, count(*) AS hits FROM srcmatches GROUP BY 1'
ORACLES["alias_matches"] = f'WITH {_EVAL} SELECT "case", rank, label, gain FROM amatches'
ORACLES["result_gains"] = f'WITH {_EVAL} SELECT "case", rank, kind, label, gain FROM gains'
_DETAILS = f"""WITH {_EVAL}, {_metric_ctes(False)}, got AS (SELECT "case", string_agg(id, ' | ' ORDER BY rank) AS ids, string_agg(name, ' | ' ORDER BY rank) AS names FROM res GROUP BY 1),
  want AS (SELECT "case", string_agg(label, ' | ' ORDER BY label) AS labels FROM (SELECT DISTINCT "case", label FROM alllab) GROUP BY 1), fr AS (SELECT "case", min(rank) AS first FROM gains WHERE gain > 0 GROUP BY 1),
  details AS (SELECT c."case", coalesce(category, 'uncategorized') AS category, q AS question, coalesce(labels, '') AS relevant_chunk_ids, coalesce(ids, '') AS retrieved_chunk_ids,
    coalesce(names, '') AS retrieved_sources, first IS NOT NULL AS source_hit, first AS first_relevant_rank, round(recall, 4) AS recall, round(precision, 4) AS precision, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg
    FROM cases c LEFT JOIN want USING ("case") LEFT JOIN got USING ("case") LEFT JOIN fr USING ("case") JOIN m USING ("case"))"""
ORACLES["case_details"] = f"{_DETAILS} SELECT * FROM details"
ORACLES["hit_counts"] = f"{_DETAILS} SELECT count_if(source_hit) AS hits, count_if(NOT source_hit) AS misses FROM details"
ORACLES["failure_analysis"] = f"""WITH {_EVAL}, f AS (SELECT c."case", min(m.rank) AS first_rank FROM (SELECT DISTINCT "case" FROM cases WHERE "case" IN (SELECT "case" FROM labels)) c
    LEFT JOIN smatches m USING ("case") GROUP BY 1), t AS (SELECT "case", string_agg(key, ' | ' ORDER BY rank) AS top FROM res GROUP BY 1),
  st AS (SELECT "case", label, 'bm25@' || min(rank) AS streams FROM dmatches GROUP BY 1, 2)
  SELECT f."case", first_rank, l.label, coalesce(streams, '') AS streams, coalesce(top, '') AS top FROM f JOIN (SELECT DISTINCT "case", label FROM labels) l USING ("case")
  LEFT JOIN st ON st."case" = f."case" AND st.label = l.label LEFT JOIN t ON t."case" = f."case" WHERE first_rank IS NULL OR first_rank > 1"""
ORACLES["rank_histogram"] = f"""WITH {_EVAL}, f AS (SELECT c."case", min(rank) AS first FROM (SELECT DISTINCT "case" FROM cases) c LEFT JOIN gains m ON m."case" = c."case" AND m.rank <= 5 GROUP BY 1),
  b AS (SELECT CASE WHEN i <= 5 THEN i::VARCHAR ELSE 'miss' END AS bucket FROM range(1, 7) t(i))
  SELECT bucket, count("case") AS cases FROM b LEFT JOIN f ON coalesce(first::VARCHAR, 'miss') = bucket GROUP BY bucket"""
_FOLD = "SELECT k, ((row_number() OVER (ORDER BY substring(md5('1729|' || k), 1, 3), md5('1729|' || k), k) - 1) % 5) AS fold FROM (SELECT DISTINCT {} AS k FROM {})"
ORACLES["fold_stats"] = f"""WITH {_EVAL}, {_metric_ctes(True)}, folds AS ({_FOLD.format('"case"', 'cases')}), j AS (SELECT m.*, fold FROM m JOIN folds ON k = m."case"),
  long AS (UNPIVOT j ON recall, precision, mrr, ndcg INTO NAME metric VALUE x), perfold AS (SELECT metric, fold, avg(x) AS x FROM long GROUP BY ALL)
  SELECT metric, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS deviation, {r6('any_value(p)')} AS p95 FROM perfold JOIN (SELECT metric, quantile_cont(x, 0.95) AS p FROM long GROUP BY 1) USING (metric) GROUP BY metric"""
ORACLES["bootstrap_comparison"] = f"""WITH {_EVAL}, {_metric_ctes(True, 2, '2').replace('first2 AS', 'first2 AS')}, {_metric_ctes(True, 5, '5')},
  b AS (SELECT x."case" AS k, y.mrr - x.mrr AS d FROM m2 x JOIN m5 y ON x."case" = y."case"),
  n AS (SELECT d, row_number() OVER (ORDER BY substring(md5('1729|' || k), 1, 3), md5('1729|' || k), k) - 1 AS n FROM b), total AS (SELECT count(*) AS t FROM n),
  draws AS (SELECT s, ('0x' || substring(md5('1729|' || s || '|' || d), 1, 12))::BIGINT % t AS n FROM total, range(5000) a(s), range((SELECT t FROM total)) c(d)),
  means AS (SELECT s, avg(d) AS m FROM draws JOIN n USING (n) GROUP BY s), q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means)
  SELECT {r6('(SELECT avg(d) FROM n)')} AS observed, {r6('lo')} AS low, {r6('hi')} AS high, lo <= 0 AND hi >= 0 AS crosses_zero FROM q"""
ORACLES["keyword_rates"] = f"""WITH c AS (SELECT case_no, max(question) AS question, max(coalesce(expected_keywords, [])) AS kw FROM benchmark_cases GROUP BY case_no)
  SELECT case_no, {r6("CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda k: contains(lower(coalesce(question, '')), lower(k))))::DOUBLE / len(kw) ELSE 1.0::DOUBLE END")} AS keyword_rate FROM c"""

_ONE = "one AS (SELECT case_no, max(category) AS category, max(split_name) AS split_name FROM benchmark_cases WHERE case_no IS NOT NULL GROUP BY case_no)"


def _alloc(target: int) -> str:
    return f"""counts AS (SELECT category, count(*) AS n FROM one GROUP BY category),
  ex AS (SELECT category, n, {target}::DOUBLE * n / sum(n) OVER () AS exact FROM counts), fl AS (SELECT *, floor(exact) AS q, round(exact - floor(exact), 9) AS rest FROM ex),
  alloc AS (SELECT category, n, (q + CASE WHEN row_number() OVER (ORDER BY rest DESC, category DESC) <= {target} - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM fl)"""


ORACLES["largest_remainder"] = f"WITH {_ONE}, {_alloc(100)} SELECT category, n, quota FROM alloc"
ORACLES["stratified_split"] = f"""WITH {_ONE}, {_alloc(200)} SELECT case_no, category, CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5('1729|' || case_no), case_no) <= quota
  THEN 'dev' ELSE 'test' END AS split FROM one JOIN alloc USING (category)"""
ORACLES["grouped_folds"] = f"WITH {_ONE} SELECT k AS case_no, fold FROM ({_FOLD.format('case_no', 'one')})"
ORACLES["label_anti_join"] = f"""WITH {_EVAL} SELECT source, count(*) AS labels FROM srclab WHERE source NOT IN (SELECT {NORM('file_name')} FROM corpus) GROUP BY source"""
ORACLES["section_pairs"] = """SELECT document_id, first, second FROM (SELECT document_id, span_id AS first, lead(span_id) OVER w AS second, row_number() OVER w AS n FROM spans
  WINDOW w AS (PARTITION BY document_id ORDER BY span_start, span_id)) WHERE n % 2 = 1 AND second IS NOT NULL"""
ORACLES["picked_sections"] = """WITH p AS (SELECT span_id, row_number() OVER (ORDER BY document_id, span_start, span_id) - 1 AS place FROM spans)
  SELECT i AS pick, span_id FROM range(25) t(i) JOIN p ON place = (3 + 7 * i) % (SELECT count(*) FROM spans)"""
ORACLES["built_cases"] = """WITH l AS (SELECT case_no, label_id, max(coalesce(gain, 1.0)) AS gain FROM case_labels WHERE kind = 'span' AND label_id IS NOT NULL GROUP BY 1, 2)
  SELECT case_no AS "case", count(*) AS labels, arg_min(label_id, (-gain, label_id)) AS best FROM l WHERE case_no IN (SELECT case_no FROM benchmark_cases) GROUP BY 1"""
ORACLES["case_faults"] = r"""WITH l AS (SELECT case_no, count(*) AS n FROM case_labels WHERE kind = 'span' AND label_id IS NOT NULL GROUP BY 1), c AS (SELECT * FROM benchmark_cases WHERE case_no IS NOT NULL)
  SELECT fault, sha256(coalesce(name, '')) AS name_hash FROM (
    SELECT 'doubled id' AS fault, case_no::VARCHAR AS name FROM c GROUP BY case_no HAVING count(*) > 1
    UNION ALL SELECT 'doubled question', q FROM (SELECT lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) AS q FROM c) GROUP BY q HAVING count(*) > 1
    UNION ALL SELECT 'no label', case_no::VARCHAR FROM c WHERE case_no NOT IN (SELECT case_no FROM l WHERE case_no IS NOT NULL)
    UNION ALL SELECT DISTINCT 'unknown span', label_id FROM case_labels WHERE kind = 'span' AND label_id IS NOT NULL AND case_no IN (SELECT case_no FROM c) AND label_id NOT IN (SELECT span_id FROM spans))"""
ORACLES["set_inventory"] = f"""WITH a AS (SELECT DISTINCT {NORM('file_name')} AS d FROM chunks), b AS (SELECT DISTINCT {NORM('document_id')} AS d FROM spans)
  SELECT 'both' AS part, count(*) AS documents FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT 'chunks only', count(*) FROM (SELECT d FROM a EXCEPT SELECT d FROM b)
  UNION ALL SELECT 'spans only', count(*) FROM (SELECT d FROM b EXCEPT SELECT d FROM a)
  UNION ALL SELECT 'shared questions', count(*) FROM (SELECT lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) FROM benchmark_cases WHERE split_name = 'train' AND question IS NOT NULL
    INTERSECT SELECT lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) FROM benchmark_cases WHERE split_name IN ('dev', 'test') AND question IS NOT NULL)"""
ORACLES["category_counts"] = f"WITH {_ONE} SELECT split_name, category, count(*) AS cases FROM one GROUP BY ALL"
ORACLES["corpus_stats"] = "SELECT count(DISTINCT file_name) AS documents, count(*) AS chunks, count(DISTINCT content) AS texts FROM chunks"
_SWEEP = f"""WITH {streams()}, raw_final AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, key) AS rank FROM latest WHERE final IS NOT NULL),
  gold AS (SELECT qid, key AS best FROM raw_final WHERE rank = 1), w AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS dense_weight), ks AS (SELECT unnest([3, 5]) AS top_k),
  fused AS (SELECT dense_weight, qid, key, sum(CASE WHEN stream = 'dense' THEN dense_weight ELSE 1 - dense_weight END * norm) AS score FROM normed, w GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY dense_weight, qid ORDER BY round(score, 9) DESC, key) AS rank FROM fused),
  hit AS (SELECT dense_weight, qid, rank FROM placed JOIN gold USING (qid) WHERE key = best AND rank <= 5),
  swept AS (SELECT dense_weight, top_k::BIGINT AS top_k, round(avg(CASE WHEN rank <= top_k THEN 1.0::DOUBLE ELSE 0 END), 4) AS recall, round(avg(CASE WHEN rank <= top_k THEN 1.0::DOUBLE / rank ELSE 0 END), 4) AS mrr
    FROM gold CROSS JOIN w CROSS JOIN ks LEFT JOIN hit USING (dense_weight, qid) GROUP BY dense_weight, top_k)"""
ORACLES["sweep_composite"] = f"{_SWEEP} SELECT dense_weight, top_k, recall, mrr FROM swept"
ORACLES["sweep_heatmap"] = f"{_SWEEP} SELECT top_k, " + ", ".join(f"round(avg(mrr) FILTER (dense_weight = 0.{i}::DOUBLE), 4) AS w{i}" for i in (3, 5, 7, 9)) + " FROM swept GROUP BY top_k"
ORACLES["window_last_four"] = """SELECT user_id, n, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 4"""
ORACLES["rare_group_collapse"] = """WITH d AS (SELECT lower(coalesce(nullif(trim(source), ''), 'unknown_source')) AS source FROM documents), k AS (SELECT source FROM d GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)
  SELECT CASE WHEN source IN (SELECT source FROM k) THEN source ELSE 'other' END AS source, count(*) AS n FROM d GROUP BY 1"""
ORACLES["group_distribution"] = """SELECT g, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS percent FROM (SELECT coalesce(nullif(trim(extension), ''), 'unknown_extension') AS g, count(*) AS n FROM documents_in GROUP BY 1)"""
ORACLES["folder_distribution"] = r"""SELECT g, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS percent FROM (
  SELECT coalesce(nullif(trim(regexp_extract(replace(coalesce(file_path, ''), '\', '/'), '^(.*)/[^/]*$', 1)), ''), 'unknown_folder') AS g, count(*) AS n FROM documents_in GROUP BY 1)"""
ORACLES["seeded_sample"] = "SELECT doc_id FROM documents ORDER BY md5('1729|' || doc_id), doc_id LIMIT 100"
ORACLES["instruction_mix"] = f"""WITH {ASKED}, s AS (SELECT weight, lower(coalesce(text, '')) AS low,
    len(list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.TECHNICAL)}), lambda t: regexp_matches(t, '[0-9_./:-]'))) > 0 AS precise FROM asked)
  SELECT CASE WHEN precise THEN 'precise' WHEN regexp_matches(low, 'difference|distinguish|what happens|under what|across') THEN 'context'
      WHEN regexp_matches(low, ' and |both|each|all parts|respectively') THEN 'multi' WHEN regexp_matches(low, 'explain|why|concept|same idea|how does') THEN 'semantic' ELSE 'generic' END AS mode,
    count(*) AS n, {r6('avg(weight)')} AS mean_weight FROM s GROUP BY 1"""
ORACLES["stream_weights"] = f"""WITH {streams()} SELECT stream, count(*) AS hits, {r6("sum(CASE stream WHEN 'dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank))")} AS mass FROM streams GROUP BY stream"""
ORACLES["heading_spans"] = "SELECT document_id, span_id, heading, heading_level, span_start, span_end FROM spans"

_DOCS = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, coalesce(page_number, 0) ORDER BY ingested_at DESC NULLS LAST, id) AS rn FROM documents_in) WHERE rn = 1 AND content IS NOT NULL)"""
_VISIBLE = "regexp_matches(content, '[^\\s]')"
for _n in ("char_chunks", "heading_chunks", "section_chunks"):
    ORACLES[_n] = f"WITH {_DOCS} SELECT id AS document_id, true AS fits, true AS \"inside\" FROM d WHERE {_VISIBLE}"
for _n in ("paragraph_chunks", "heading_context_chunks"):
    ORACLES[_n] = f"""WITH {_DOCS}, w AS (SELECT id, length(content) AS n, length(regexp_extract(content, '^\\s*')) AS lead, regexp_extract(content, '\\s*$') AS tail FROM d WHERE {_VISIBLE})
  SELECT id AS document_id, lead AS first, CASE WHEN regexp_matches(tail, '\\n\\s*\\n') THEN n - length(tail) + strpos(tail, chr(10)) - 1 ELSE n END AS last, true AS exact FROM w"""
ORACLES["cluster_terms"] = f"""WITH d AS (SELECT coalesce(lang, 'none') AS cluster, doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT cluster, doc_id, unnest({word('text')}) AS w FROM d),
  c AS (SELECT cluster, w, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL), i AS (SELECT w, ln(((SELECT count(*) FROM d) + 1) / (sum(df) + 1.0::DOUBLE)) AS idf FROM c GROUP BY w HAVING sum(df) >= 2),
  m AS (SELECT cluster, w, round(tf * idf / n, 9) AS mean FROM c JOIN i USING (w) JOIN (SELECT cluster, count(*) AS n FROM d GROUP BY 1) USING (cluster)),
  p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, w) AS place FROM m WHERE mean > 0)
  SELECT cluster, string_agg(w, ' / ' ORDER BY place) AS terms FROM p WHERE place <= 3 GROUP BY cluster"""
