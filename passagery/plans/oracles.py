"""DuckDB statements equal to the registered queries that SQL can express."""

from __future__ import annotations

from passagery.functions import signals as S
from passagery.functions import text as T

ORACLES: dict[str, str] = {}


def lst(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def re_(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def word(c: str, stop: tuple[str, ...] = T.STOP_DEFAULT, least: int = 2) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), {re_(T.WORD)}), lambda t: length(t) >= {least} AND NOT list_contains({lst(stop)}, t))"


def identifier(c: str) -> str:
    raw = (
        f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), {re_(T.IDENTIFIER)}), lambda t: lower(t)), "
        f"lambda t: length(t) > 1 AND (NOT list_contains({lst(T.STOP_FIELDS)}, t) OR regexp_matches(t, '[0-9]')))"
    )
    return (
        f"flatten(list_transform({raw}, lambda t: list_concat([t], CASE WHEN regexp_matches(t, '[-_]') "
        f"THEN list_filter(string_split_regex(t, '[-_]'), lambda p: length(p) > 1) ELSE [] END)))"
    )


def bigrams(tokens: str) -> str:
    return f"list_concat({tokens}, list_transform(range(1, len({tokens})), lambda nth: {tokens}[nth] || ' ' || {tokens}[nth + 1]))"


def technical(c: str) -> str:
    raw = (
        f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), {re_(T.TECHNICAL)}), "
        f"lambda t: length(t) > 1 AND NOT list_contains({lst(T.STOP_FIELDS)}, t))"
    )
    return (
        f"flatten(list_transform({raw}, lambda t: list_concat([t], CASE WHEN regexp_matches(t, '[_.:/-]') "
        f"THEN list_filter(string_split_regex(t, '[_.:/-]+'), lambda p: length(p) > 1 AND NOT list_contains({lst(T.STOP_FIELDS)}, p)) ELSE [] END)))"
    )


def runs(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), {re_(T.RUN)}), lambda t: regexp_replace(t, '^-+|-+$', '', 'g'))"


def r6(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0::DOUBLE"


CORPUS = """corpus AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, chunk_id || '@' || coalesce(page_number, 0)::VARCHAR AS key,
           row_number() OVER (PARTITION BY chunk_id, coalesce(page_number, 0) ORDER BY ingested_at DESC NULLS LAST, content, document_id) AS rn
    FROM chunks) WHERE rn = 1)"""
ASKED = "asked AS (SELECT query_id || '/' || query_variant AS qid, query_id, query_variant AS variant, text, weight FROM queries)"
LATEST = """latest AS (
  SELECT query_id AS qid, chunk_key AS key, dense, sparse, late, final FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, chunk_key ORDER BY scored_at DESC NULLS LAST, loaded_at DESC NULLS LAST,
        dense DESC NULLS LAST, sparse DESC NULLS LAST, late DESC NULLS LAST, final DESC NULLS LAST) AS rn
    FROM (SELECT *, CASE WHEN NOT isnan(dense_score) THEN dense_score END AS dense, CASE WHEN NOT isnan(sparse_score) THEN sparse_score END AS sparse,
                 CASE WHEN NOT isnan(late_interaction_score) THEN late_interaction_score END AS late,
                 CASE WHEN NOT isnan(final_score) THEN final_score END AS final
          FROM native_candidates WHERE query_id IS NOT NULL AND chunk_key IS NOT NULL)) WHERE rn = 1)"""


def streams(*names: str) -> str:
    names = names or ("dense", "sparse")
    union = " UNION ALL ".join(f"SELECT qid, key, '{n}' AS stream, {n} AS score FROM latest WHERE {n} IS NOT NULL" for n in names)
    return (
        f"{LATEST}, raw_streams AS ({union}), streams AS (SELECT *, row_number() OVER (PARTITION BY qid, stream "
        "ORDER BY round(score, 9) DESC, key) AS rank FROM raw_streams), normed AS (SELECT *, CASE WHEN hi = lo THEN 1.0::DOUBLE "
        "ELSE (score - lo) / (hi - lo) END AS norm FROM (SELECT *, min(score) OVER (PARTITION BY qid, stream) AS lo, "
        "max(score) OVER (PARTITION BY qid, stream) AS hi FROM streams))"
    )


def bm25(q: str, qtok: str, c: str, key: str, tok: str, k1: str = "1.5::DOUBLE", b: str = "0.75::DOUBLE") -> str:
    """CTEs that end in scores(qid, key, score)."""
    return f"""
  toks AS (SELECT {key} AS key, {tok} AS t FROM {c}),
  stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
  posts AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
  raw_idf AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM posts, stats GROUP BY term),
  idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf),
  terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({qtok}) AS term FROM {q}) GROUP BY ALL),
  scores AS (SELECT qid, key, sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
             FROM terms JOIN idf USING (term) JOIN posts USING (term), stats GROUP BY qid, key)"""


def top(src: str, k: int, positive: bool = True) -> str:
    keep = "AND score > 0" if positive else ""
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM {src}) WHERE rank <= {k} {keep})"
    )


ORACLES["tokenize_stats"] = f"""SELECT lang, count(*) AS docs, sum(len(t))::BIGINT AS tokens, max(len(t)) AS longest,
  sum(len(list_distinct(t)))::BIGINT AS distinct_tokens FROM (SELECT lang, {word('text')} AS t FROM documents) GROUP BY lang"""
ORACLES["doc_frequency"] = f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
  FROM (SELECT doc_id, unnest({word('text')}) AS term FROM documents) GROUP BY term"""
ORACLES["identifier_bigrams"] = f"""SELECT term, count(*) AS n FROM (SELECT unnest({bigrams('i')}) AS term FROM (SELECT {identifier('text')} AS i FROM queries)) GROUP BY term"""
ORACLES["technical_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest({technical('question')}) AS term FROM benchmark_cases) GROUP BY term"
ORACLES["overlap_vocabulary"] = f"""SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(list_filter({runs('text')},
  lambda t: regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9_-]*$')), lambda t: lower(t)),
  lambda t: length(t) > 1 AND NOT list_contains({lst(T.STOP_OVERLAP)}, t)))) AS term FROM queries) GROUP BY term"""
ORACLES["ltr_vocabulary"] = f"""SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(list_filter({runs('text')},
  lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$')), lambda t: lower(t)),
  lambda t: NOT list_contains({lst(T.STOP_LTR)}, t))) AS term FROM queries) GROUP BY term"""
ORACLES["heading_slugs"] = r"""SELECT slug, count(*) AS n FROM (SELECT coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(lower(heading), 'ß', 'ss'), '[`*_]', '', 'g'),
  '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM spans) GROUP BY slug"""
ORACLES["label_sources"] = r"SELECT lower(trim(replace(coalesce(document_id, ''), '\', '/'))) AS source, count(*) AS labels FROM case_labels GROUP BY 1"
ORACLES["question_forms"] = r"""SELECT sha256(q) AS question_hash, cases, first_case FROM (SELECT lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) AS q,
  count(DISTINCT case_no) AS cases, min(case_no) AS first_case FROM benchmark_cases GROUP BY 1)"""
ORACLES["display_titles"] = r"""SELECT doc_id, CASE WHEN length(f) > 120 THEN substring(f, 1, 120) || '...' ELSE f END AS shown
  FROM (SELECT doc_id, replace(text, chr(10), ' ') AS f FROM documents)"""
ORACLES["bm25_topk"] = f"WITH {CORPUS}, {ASKED}, {bm25('asked', word('text'), 'corpus', 'key', word('content'))} SELECT qid, rank, key, {r6('score')} AS score FROM {top('scores', 5)}"
_SWEEP = " UNION ALL ".join(f"SELECT {k}::DOUBLE AS k1, {b}::DOUBLE AS b" for k in (0.9, 1.2, 1.5) for b in (0.3, 0.75))
ORACLES["bm25_k1b_sweep"] = f"""WITH {CORPUS}, {ASKED}, orig AS (SELECT * FROM asked), grid AS ({_SWEEP}),
  {bm25('orig', word('text'), 'corpus', 'key', word('content'))},
  swept AS (SELECT qid, k1, b, key, sum(qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) AS score
    FROM terms JOIN idf USING (term) JOIN posts USING (term), stats, grid GROUP BY ALL)
  SELECT qid, k1, b, key, {r6('score')} AS score FROM swept WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY qid, k1, b ORDER BY round(score, 9) DESC, key) = 1"""
ORACLES["field_bm25"] = f"""WITH {CORPUS}, {ASKED}, orig AS (SELECT * FROM asked),
  fields AS (SELECT key, 'title' AS field, coalesce(string_split(coalesce(heading_path, ''), ' > ')[1], '') AS text, 3.0::DOUBLE AS w FROM corpus
    UNION ALL SELECT key, 'heading', coalesce(heading_path, ''), 2.0 FROM corpus UNION ALL SELECT key, 'body', content, 1.0 FROM corpus),
  toks AS (SELECT key, field, w, {bigrams('i')} AS t FROM (SELECT *, {identifier('text')} AS i FROM fields)),
  stats AS (SELECT field, any_value(w) AS w, count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks GROUP BY field),
  posts AS (SELECT key, field, dl, term, count(*) AS tf FROM (SELECT key, field, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
  raw_idf AS (SELECT field, term, ln(any_value(n_docs) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM posts JOIN stats USING (field) GROUP BY field, term),
  idf AS (SELECT field, term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY field) ELSE raw END AS idf FROM raw_idf),
  terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({bigrams('i')}) AS term FROM (SELECT qid, {identifier('text')} AS i FROM orig)) GROUP BY ALL),
  scores AS (SELECT qid, field, key, sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s
    FROM terms JOIN idf USING (term) JOIN posts USING (field, term) JOIN stats USING (field) GROUP BY ALL),
  span AS (SELECT qid, field, CASE WHEN count(*) < any_value(n_docs) THEN least(min(s), 0) ELSE min(s) END AS lo,
    CASE WHEN count(*) < any_value(n_docs) THEN greatest(max(s), 0) ELSE max(s) END AS hi, any_value(w) AS w FROM scores JOIN stats USING (field) GROUP BY qid, field),
  summed AS (SELECT qid, key, sum(w * (s - lo) / (hi - lo)) AS score FROM scores JOIN span USING (qid, field) WHERE hi > lo GROUP BY qid, key)
  SELECT qid, rank, key, {r6('score')} AS score FROM {top('summed', 5)}"""
ORACLES["corpus_bm25_stats"] = f"WITH {CORPUS}, {ASKED}, {bm25('asked', word('text'), 'corpus', 'key', word('content'))} SELECT term, df, {r6('idf')} AS idf FROM idf"
ORACLES["corpus_profile_bm25"] = f"""WITH {CORPUS}, {ASKED}, orig AS (SELECT * FROM asked),
  {bm25('orig', technical('text'), 'corpus', 'key', technical('content'), '1.2::DOUBLE')},
  span AS (SELECT qid, CASE WHEN count(*) < (SELECT n_docs FROM stats) THEN least(min(score), 0) ELSE min(score) END AS lo, max(score) AS hi FROM scores GROUP BY qid)
  SELECT qid, rank, key, {r6('CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0::DOUBLE END')} AS norm FROM {top('scores', 5, False)} JOIN span USING (qid)"""
ORACLES["minmax_normalise"] = f"WITH {streams()} SELECT qid, stream, key, rank, {r6('norm')} AS norm FROM normed"


def _fuse(part: str, k: int = 10) -> str:
    return f"""WITH {streams()}, weighted AS (SELECT *, CASE stream WHEN 'dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w FROM normed),
  fused AS (SELECT qid, key, sum({part}) AS score, min({{'s': stream, 'r': rank}}) AS f FROM weighted GROUP BY qid, key),
  placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, f.s, f.r, key) AS rank FROM fused)"""


for _n, _p in (("weighted_linear", "w * norm"), ("rrf", "1.0::DOUBLE / (60 + rank)"), ("weighted_rrf", "w / (60 + rank)")):
    ORACLES[f"fuse_{_n}"] = f"{_fuse(_p)} SELECT qid, rank, key, {r6('score')} AS score FROM placed WHERE rank <= 10"
_VW = "CASE variant WHEN 'original' THEN 1.0::DOUBLE WHEN 'rewrite' THEN 0.7::DOUBLE WHEN 'expansion' THEN 0.5::DOUBLE WHEN 'prf' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END"
for _n, _p in (("fuse_variants", f"{_VW} / (60 + rank)"), ("fuse_variants_rrf", "1.0::DOUBLE / (60 + rank)"), ("fuse_variants_linear", f"{_VW} * norm")):
    ORACLES[_n] = f"""WITH {CORPUS}, {ASKED}, {bm25('asked', word('text'), 'corpus', 'key', word('content'))},
  lists AS (SELECT string_split(qid, '/')[1] AS qid, string_split(qid, '/')[-1] AS variant, key, score, rank,
    CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
    FROM {top('scores', 10)} WINDOW w AS (PARTITION BY qid)),
  many AS (SELECT qid, count(DISTINCT variant) AS n FROM lists GROUP BY qid),
  fused AS (SELECT qid, key, sum(CASE WHEN n = 1 THEN score ELSE {_p} END) AS score FROM lists JOIN many USING (qid) GROUP BY qid, key)
  SELECT qid, rank, key, {r6('score')} AS score FROM {top('fused', 5)}"""
ORACLES["hierarchy_bonus"] = f"""{_fuse('w * norm')}, {CORPUS}, paths AS (SELECT chunk_id, arg_min(coalesce(heading_path, ''), (coalesce(page_number, 0), coalesce(heading_path, ''))) AS h FROM corpus GROUP BY 1),
  sec AS (SELECT fused.*, string_split(key, '::')[1] || chr(1) || coalesce(h, '') AS section FROM fused LEFT JOIN paths ON chunk_id = key),
  best AS (SELECT qid, section, max(score) AS best FROM sec GROUP BY ALL),
  bonus AS (SELECT qid, section, (count(*) OVER (PARTITION BY qid) - (row_number() OVER (PARTITION BY qid ORDER BY round(best, 9) DESC, section) - 1))::DOUBLE
    / greatest(1, count(*) OVER (PARTITION BY qid)) * 0.08::DOUBLE AS bonus FROM best),
  boosted AS (SELECT qid, key, score + bonus AS score FROM sec JOIN bonus USING (qid, section))
  SELECT qid, rank, key, {r6('score')} AS score FROM {top('boosted', 5)}"""
ORACLES["component_trace"] = f"""WITH {streams('dense', 'sparse', 'late')}, fin AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, key) AS final_rank FROM latest WHERE final IS NOT NULL),
  t AS (SELECT qid, key, {", ".join(f"max(rank) FILTER (stream = '{n}') AS {n}_rank, {r6(f"max(score) FILTER (stream = '{n}')")} AS {n}_score" for n in ("dense", "sparse", "late"))},
    count(DISTINCT stream) AS stream_count FROM streams GROUP BY qid, key)
  SELECT t.*, final_rank FROM t LEFT JOIN fin USING (qid, key)"""
ORACLES["native_rerank"] = f"""WITH {streams('dense', 'sparse', 'late')}, f AS (SELECT qid, key, sum(CASE stream WHEN 'dense' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * norm) AS score,
  max(rank) FILTER (stream = 'dense') AS dense_rank FROM normed GROUP BY qid, key)
  SELECT qid, rank, key, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, dense_rank NULLS LAST, key) AS rank FROM f) WHERE rank <= 10"""
ORACLES["confidence"] = f"""{_fuse('w * norm')}, gap AS (SELECT qid, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM placed GROUP BY qid),
  tops AS (SELECT qid, max(key) FILTER (stream = 'dense') AS d, max(key) FILTER (stream = 'sparse') AS s FROM streams WHERE rank = 1 GROUP BY qid)
  SELECT qid, round(0.5::DOUBLE * CASE WHEN s2 IS NULL THEN 0.25::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, s1 - s2) * 5.0::DOUBLE) END
    + 0.5::DOUBLE * CASE WHEN d IS NULL OR s IS NULL THEN 0.25::DOUBLE WHEN d = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS confidence FROM gap LEFT JOIN tops USING (qid)"""
_AGREE = """tops AS (SELECT qid, stream, max(key) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS s1, coalesce(max(score) FILTER (rank = 2), 0) AS s2
    FROM streams WHERE rank <= 2 GROUP BY qid, stream),
  votes AS (SELECT qid, top, count(*) AS n, sum(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (s1 - s2) / greatest(abs(s1), 1e-8::DOUBLE)))) AS lead FROM tops GROUP BY qid, top),
  agree AS (SELECT qid, round(max(n)::DOUBLE / sum(n)::DOUBLE, 4) AS agreement, round(sum(lead) / sum(n)::DOUBLE, 4) AS margin FROM votes GROUP BY qid)"""
ORACLES["stream_agreement"] = f"WITH {streams('dense', 'sparse', 'late')}, {_AGREE} SELECT qid, agreement, margin FROM agree"
ORACLES["cascade_depth"] = f"""WITH {streams('dense', 'sparse', 'late')}, {_AGREE}, c AS (SELECT qid, round(0.5::DOUBLE * agreement + 0.5::DOUBLE * margin, 4) < 0.42::DOUBLE AS escalated FROM agree)
  SELECT qid, bool_or(escalated) AS escalated, count(*) AS rows FROM streams JOIN c USING (qid) WHERE rank <= CASE WHEN escalated THEN 50 ELSE 20 END GROUP BY qid"""
ORACLES["additive_feedback"] = f"""WITH {streams()}, u AS (SELECT qid, key, score AS part, NULL::BIGINT AS fr FROM streams WHERE stream = 'dense' AND rank <= 20
    UNION ALL SELECT qid, key, 0.25::DOUBLE * score, rank FROM streams WHERE stream = 'sparse' AND rank <= 20)
  SELECT qid, key, {r6('sum(part)')} AS score, max(fr) AS feedback_rank FROM u GROUP BY qid, key"""
_GATE = f"""gate AS (SELECT qid, text, list_filter({runs('text')}, lambda t: t <> '') AS toks,
  list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.WORD)}), lambda t: regexp_matches(t, '^[A-Z][A-Z0-9]+$')) AS acronyms,
  regexp_extract_all(coalesce(text, ''), {re_(S.QUOTED)}, 1) AS quoted_terms,
  list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.WORD)}), lambda t: regexp_matches(t, '^[1-5][0-9]{{2}}$')) AS numeric_codes,
  list_filter({runs('text')}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+$')) AS identifiers,
  list_filter({lst(S.PRECISION)}, lambda p: contains(lower(coalesce(text, '')), p)) AS precision,
  list_filter({lst(S.AMBIGUITY)}, lambda p: contains(lower(coalesce(text, '')), p)) AS amb FROM asked),
  gated AS (SELECT *, CASE WHEN len(list_filter(toks, lambda t: list_contains({lst(S.PRONOUNS)}, lower(t)))) > 0 THEN list_concat(amb, ['pronoun']) ELSE amb END AS ambiguity FROM gate)"""
ORACLES["query_signals"] = f"""WITH {ASKED}, {_GATE} SELECT qid, len(toks) AS token_count, len(acronyms) AS acronyms, len(quoted_terms) AS quoted_terms,
  len(numeric_codes) AS numeric_codes, len(identifiers) AS identifiers, coalesce(array_to_string(precision, '|'), '') AS precision_markers,
  coalesce(array_to_string(ambiguity, '|'), '') AS ambiguity_markers FROM gated"""
ORACLES["query_decisions"] = f"""WITH {ASKED}, {_GATE}, p AS (SELECT *, list_concat(list_filter([CASE WHEN len(acronyms) > 0 THEN 'acronym' END, CASE WHEN len(quoted_terms) > 0 THEN 'quoted_term' END,
  CASE WHEN len(numeric_codes) > 0 THEN 'numeric_code' END, CASE WHEN len(identifiers) > 0 THEN 'identifier' END], lambda x: x IS NOT NULL), precision) AS protected FROM gated)
  SELECT qid, coalesce(array_to_string(protected, '|'), '') AS protected, len(protected) = 0 AND (len(ambiguity) > 0 OR
    (regexp_matches(coalesce(text, ''), {re_(S.QUESTION_START)}) AND len(toks) >= 7)) AS should_route,
  coalesce(nullif(concat_ws('|', CASE WHEN len(protected) > 0 THEN 'precision-preserving query' END, CASE WHEN len(ambiguity) > 0 THEN 'underspecified natural-language signal'
    WHEN len(protected) = 0 AND regexp_matches(coalesce(text, ''), {re_(S.QUESTION_START)}) AND len(toks) >= 7 THEN 'long semantic question' END), ''), 'short or non-question query') AS reasons FROM p"""
_LEX = f"""(len(list_filter({runs('text')}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z0-9_-]{{1,9}}$') AND upper(t) = t AND regexp_matches(t, '[A-Z]'))) > 0
  OR regexp_matches(coalesce(text, ''), '[`"''][^`"'']+[`"'']')
  OR len(list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.WORD)}), lambda t: regexp_matches(t, '^[0-9]{{3}}$'))) > 0
  OR len(list_filter({runs('text')}, lambda t: regexp_matches(t, '^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+$'))) > 0)"""
ORACLES["adaptive_weights"] = f"""WITH {ASKED}, l AS (SELECT qid, {_LEX} AS lex, len(list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda t: t <> '')) >= 7 AS long FROM asked)
  SELECT qid, CASE WHEN lex THEN 0.35::DOUBLE WHEN long THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS dense_weight,
  CASE WHEN lex THEN 0.65::DOUBLE WHEN long THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS sparse_weight FROM l"""
ORACLES["instruction_modes"] = f"""WITH q AS (SELECT question AS text FROM benchmark_cases UNION SELECT heading FROM spans UNION SELECT title FROM documents), s AS (SELECT text, lower(coalesce(text, '')) AS low, len({identifier('text')}) AS n,
    len(list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.IDENTIFIER)}), lambda t: regexp_matches(t, '[-_]') OR (upper(t) = t AND regexp_matches(t, '[A-Z]')) OR regexp_matches(t, '^[0-9]+$'))) > 0
      OR len(regexp_extract_all(coalesce(text, ''), {re_(S.QUOTED)})) > 0 AS lex,
    len(list_filter({lst(S.FIELD_MARKERS)}, lambda p: contains(lower(coalesce(text, '')), p))) > 0 AS amb,
    len(list_filter(regexp_extract_all(coalesce(text, ''), {re_(T.TECHNICAL)}), lambda t: regexp_matches(t, '[0-9_./:-]'))) > 0 AS precise FROM q)
  SELECT CASE WHEN lex THEN 'precision' WHEN amb OR n <= 6 THEN 'ambiguity' WHEN n >= 14 OR contains(low, ' and ') THEN 'multiple' ELSE 'semantic' END AS field_mode,
    CASE WHEN precise THEN 'precise' WHEN regexp_matches(low, 'difference|distinguish|what happens|under what|across') THEN 'context'
      WHEN regexp_matches(low, ' and |both|each|all parts|respectively') THEN 'multi' WHEN regexp_matches(low, 'explain|why|concept|same idea|how does') THEN 'semantic' ELSE 'generic' END AS corpus_mode,
    count(*) AS questions FROM s GROUP BY ALL"""
_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
ORACLES["cosine_topk"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
  s AS (SELECT a.vec_id AS qid, b.vec_id AS key, round(list_dot_product(a.v, b.v) / (a.n * b.n), 5) AS score FROM u a, u b WHERE a.vec_id % 20 = 0)
  SELECT qid, rank, key, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5"""
ORACLES["label_cohesion"] = f"""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL) SELECT label, {r6('sqrt(sum(m * m))')} AS length, max(n) AS vectors FROM m GROUP BY label"""
ORACLES["vector_norms"] = f"SELECT vec_id, len(embedding) AS dims, {r6('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS length FROM embeddings"
ORACLES["native_pool"] = f"""WITH {streams()}, seat AS (SELECT qid, key, min(CASE stream WHEN 'dense' THEN 0 ELSE 1000 END + rank) AS spot FROM streams WHERE rank <= 10 GROUP BY qid, key),
  pool AS (SELECT qid, key, spot FROM seat UNION ALL SELECT qid, key, 2000 FROM latest WHERE qid NOT IN (SELECT qid FROM seat))
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY late DESC NULLS LAST, spot, key) AS rank, key, {r6('late')} AS score FROM pool JOIN latest USING (qid, key)"""
ORACLES["routing_summary"] = f"""WITH conf AS ({ORACLES['confidence']}), q AS (SELECT query_id AS qid, bool_or(query_variant = 'rewrite') AS r, bool_or(query_variant = 'expansion') AS e,
    bool_or(query_variant = 'prf') AS p, count(*) AS n FROM queries GROUP BY 1), d AS (SELECT q.*, confidence AS c FROM q LEFT JOIN conf USING (qid))
  SELECT count(*) AS cases, count_if(r) AS rewrite_count, round(100.0::DOUBLE * count_if(r) / count(*), 4) AS rewrite_rate_percent, count_if(e) AS expansion_count,
    round(100.0::DOUBLE * count_if(e) / count(*), 4) AS expansion_rate_percent, count_if(p) AS prf_count, round(100.0::DOUBLE * count_if(p) / count(*), 4) AS prf_rate_percent,
    count_if(c < 0.5) AS confidence_trigger_count, coalesce(round(avg(c), 4), 0.0::DOUBLE) AS average_confidence, round(avg(n), 4) AS average_query_variant_count FROM d"""
ORACLES["latency_summary"] = """SELECT round(avg(value), 3) AS mean_ms, round(list_sort(list(value))[ceil(0.95::DOUBLE * count(value))::BIGINT], 3) AS p95_ms,
  round(100.0::DOUBLE * avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END), 4) AS escalation_rate_percent FROM events"""
ORACLES["policies"] = f"""WITH d AS ({ORACLES['query_decisions']}) SELECT policy, count_if(policy = 'always' OR policy = 'selective' AND should_route) AS rewritten, count(*) AS queries
  FROM d, (SELECT unnest(['never', 'selective', 'always']) AS policy) GROUP BY policy"""
_SEC = "((span_end - span_start) * 7)"
ORACLES["section_topics"] = f"""SELECT span_id, array_to_string(list_filter(regexp_extract_all(heading, '[A-Za-z][A-Za-z0-9_.-]+'), lambda t: NOT list_contains({lst(T.STOP_FIELDS)}, lower(t)))[1:4], ' ') AS topic,
  CASE WHEN {_SEC} >= 3600 THEN ({_SEC} // 3600) || 'h ' || ({_SEC} % 3600 // 60) || 'm ' || ({_SEC} % 60) || 's'
    WHEN {_SEC} >= 60 THEN ({_SEC} // 60) || 'm ' || ({_SEC} % 60) || 's' ELSE {_SEC} || 's' END AS took FROM spans WHERE heading IS NOT NULL"""
ORACLES["encoder_texts"] = f"""WITH {ASKED} SELECT qid, model, CASE model WHEN 'e5-base' THEN 'query: ' || text WHEN 'Qwen3-Embedding' THEN 'Instruct: find it' || chr(10) || 'Query: ' || text ELSE text END AS given
  FROM asked, (SELECT unnest(['e5-base', 'Qwen3-Embedding', 'other']) AS model)"""
