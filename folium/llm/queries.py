"""The queries of the training-data operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folium.llm.decontamination import op8_decontamination
from folium.llm.exact_dedup import op1_exact_dedup
from folium.llm.jaccard_join import op6_jaccard_join
from folium.llm.language_vectors import op13_language_id
from folium.llm.license_scan import op4_license_scan
from folium.llm.periodic_runs import op11_periodic_runs
from folium.llm.piece_viterbi import op9_sentencepiece
from folium.llm.quality_ftrl import op7_quality
from folium.llm.repeat_parse import op10_repeats
from folium.llm.secret_scan import op2_secret_ownership
from folium.llm.token_alignment import op12_token_alignment
from folium.llm.token_blocks import op3_token_blocks
from folium.llm.toxicity_fm import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_secret_ownership, op3_token_blocks, op4_license_scan, op5_toxicity, op6_jaccard_join, op7_quality, op8_decontamination, op9_sentencepiece, op10_repeats, op11_periodic_runs, op12_token_alignment, op13_language_id)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


ORACLE: dict[str, str] = {}

ORACLE["op1_exact_dedup"] = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), w AS (
    SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
        bool_or(doc_id % 2 = 0) OVER (PARTITION BY text_sha256) AS member
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256, member FROM w
"""

_SECRET_KINDS = [
    ("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    ("hex", 2, "[0-9a-f]+", 0, 32),
]


def _matches(name: str, number: int, pattern: str, group: int, least: int) -> str:
    """Matches with their starts: what stands between the matches, and the matches, are as long as all text up to there."""
    return f"""
    SELECT k, doc_id, owner, repository, {number} AS kind, '{name}' AS name, g, sum(length(g) + length(m)) OVER (PARTITION BY k ORDER BY i) AS e, length(m) AS n, v FROM (
        SELECT k, doc_id, owner, repository, unnest(regexp_split_to_array(t, '{pattern}')[:-2]) AS g, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m,
            unnest(regexp_extract_all(t, '{pattern}', {group})) AS v, unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i
        FROM d
    ) QUALIFY length(v) >= {least}"""


ORACLE["op2_secret_ownership"] = f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repository FROM documents
), base AS ({" UNION ALL ".join(_matches(*x) for x in _SECRET_KINDS)}), held AS (
    SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT (coalesce(owner, chr(1)), coalesce(repository, chr(1)))) AS repositories,
        len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]') AS random FROM base GROUP BY v
), marks AS (
    SELECT k, kind, name, e - n AS s, e FROM base
    UNION SELECT k, 3, 'example', e - n, e FROM base JOIN held USING (v) WHERE owners >= 3 OR repositories >= 4
    UNION SELECT k, 4, 'live', e - n, e FROM base JOIN held USING (v) WHERE repositories = 1 AND random
    UNION SELECT k, 5, 'shared', e - n, e FROM base JOIN held USING (v) WHERE owners < 3 AND repositories BETWEEN 2 AND 3 AND random
), joined AS (
    SELECT k, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
        count(*) FILTER (WHERE kind = 3) AS x, count(*) FILTER (WHERE kind = 4) AS l, count(*) FILTER (WHERE kind = 5) AS h,
        string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base,
        string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans
    FROM marks GROUP BY k
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(x, 0) AS n_example, coalesce(l, 0) AS n_live, coalesce(h, 0) AS n_shared
FROM d LEFT JOIN joined USING (k)
"""
