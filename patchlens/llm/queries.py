"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from patchlens.llm import chat, fim, mixing, roles, sharding, substrings, warc
from patchlens.llm.ann import op8_collision_counting_ann
from patchlens.llm.chat import op6_chat_windows
from patchlens.llm.embedding_dedup import op7_int8_embedding_dedup
from patchlens.llm.fim import op13_seekable_fim
from patchlens.llm.langid import op3_ppm_language
from patchlens.llm.mixing import op1_mix_raked_sources
from patchlens.llm.near_dup import op5_bottom_k_near_dup
from patchlens.llm.packing import op4_best_fit_packing
from patchlens.llm.pii import op10_feistel_pseudonyms
from patchlens.llm.roles import op12_lr_role_repair
from patchlens.llm.sharding import op9_hash_tree_sharding
from patchlens.llm.substrings import op11_fm_substrings
from patchlens.llm.warc import op2_warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_raked_sources, op2_warc_revisits, op3_ppm_language, op4_best_fit_packing, op5_bottom_k_near_dup, op6_chat_windows,
        op7_int8_embedding_dedup, op8_collision_counting_ann, op9_hash_tree_sharding, op10_feistel_pseudonyms, op11_fm_substrings, op12_lr_role_repair, op13_seekable_fim,
    )
}

ORACLES = {"op1_mix_raked_sources": mixing.ORACLE_SQL, "op2_warc_revisits": warc.ORACLE_SQL, "op6_chat_windows": chat.ORACLE_SQL, "op9_hash_tree_sharding": sharding.ORACLE_SQL, "op11_fm_substrings": substrings.ORACLE_SQL, "op12_lr_role_repair": roles.ORACLE_SQL, "op13_seekable_fim": fim.ORACLE_SQL}

#: DuckDB SQL for operators whose whole rule SQL can state by brute force.
ORACLES["op7_int8_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS p, b.vec_id AS q FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.q, r.low FROM reach r JOIN pairs p ON p.p = r.id WHERE r.low < p.q),
least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, count(p.q)::BIGINT AS n_links, any_value(l.component_id) AS component_id, v.vec_id = any_value(l.component_id) AS kept
FROM v JOIN least l ON l.id = v.vec_id LEFT JOIN pairs p ON p.p = v.vec_id GROUP BY v.vec_id"""

ORACLES["op5_bottom_k_near_dup"] = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 3], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
half AS MATERIALIZED (SELECT p, q FROM common JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * k >= 80 * (x.n + y.n - k)),
links AS MATERIALIZED (SELECT p, q FROM half UNION ALL SELECT q, p FROM half),
reach(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.q, r.low FROM reach r JOIN links l ON l.p = r.id WHERE r.low < l.q),
least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON id = d.doc_id"""
