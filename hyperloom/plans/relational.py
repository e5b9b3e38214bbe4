"""Plans that are plainly relational: scans, guards, joins, aggregates, windows and graph templates."""

from __future__ import annotations

from .catalogue import plan
from .dialect import duck, run

TEXTS: dict[str, str] = {
    # text and scalar functions
    "trigger_hits": "SELECT doc_id, frame_id, trigger FROM hit",
    "coverage_completeness": "SELECT d.doc_id, round(least(sum(length(d.text) - length(replace(d.text, t.trigger, ''))), length(d.text)) / length(d.text), 6) AS completeness, sum((length(d.text) - length(replace(d.text, t.trigger, ''))) / length(t.trigger)) AS n_found FROM documents d JOIN frame_trigger t ON contains(d.text, t.trigger) GROUP BY d.doc_id, d.text",
    "hash_bucket": "SELECT word, count(*) AS n, @HEX(word;30;3)@ % 512 AS bucket FROM word GROUP BY word",
    "signed_embed": "SELECT doc_id, sqrt(sum(v * v)) AS norm, count(*) AS n_buckets FROM (SELECT doc_id, bucket, sum(s) AS v FROM (SELECT doc_id, @HEX(word;30;3)@ % 512 AS bucket, CASE WHEN substr(md5(word), 17, 1) >= '8' THEN 1 ELSE -1 END AS s FROM word) w GROUP BY doc_id, bucket) b GROUP BY doc_id",
    "infer_type": "SELECT frame_id, CASE WHEN source_domain LIKE '%of%' THEN 'FLUID' WHEN source_domain LIKE '%to%' OR source_domain LIKE '%is%' THEN 'PATH' WHEN source_domain LIKE '%der%' THEN 'BODY' ELSE 'GENERIC' END AS inferred, source_type FROM wide_spec",
    "type_coherence": "SELECT frame_id, inferred, source_type, (inferred = source_type OR inferred = 'GENERIC' OR source_type = 'GENERIC') AS coherent FROM (SELECT frame_id, source_type, CASE WHEN source_domain LIKE '%of%' THEN 'FLUID' WHEN source_domain LIKE '%to%' OR source_domain LIKE '%is%' THEN 'PATH' WHEN source_domain LIKE '%der%' THEN 'BODY' ELSE 'GENERIC' END AS inferred FROM wide_spec) x",
    "sentiment": "SELECT doc_id, CASE WHEN contains(text, 'loser') OR contains(text, 'idiot') THEN 'anxious' WHEN contains(text, 'the') OR contains(text, 'der') THEN 'warm' ELSE 'none' END AS mood FROM documents",
    "stable_ids": "SELECT frame_id, 'F_LLM_' || substr(md5(concat(source_domain, '||', target_domain)), 1, 8) AS sid FROM wide_spec",
    "escape_text": "SELECT item_id, replace(replace(text, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) AS escaped FROM benchmark",
    "dominant_field": "SELECT doc_id, field, n FROM (SELECT doc_id, field, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos, field) AS r FROM (SELECT w.doc_id, f.source_type AS field, count(*) AS n, min(w.pos) AS first_pos FROM word w JOIN frame_trigger t ON w.word = t.trigger JOIN frame_spec f ON f.frame_id = t.frame_id GROUP BY w.doc_id, f.source_type) x) y WHERE r = 1",
    "marker_window": "SELECT doc_id, pos, near FROM (SELECT doc_id, pos, word, max(CASE WHEN word IN ('the', 'der', 'que', 'le') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM word) x WHERE word IN ('was', 'und', 'los', 'de')",
    "mipvu_candidates": "SELECT doc_id, frame_id, min(pos) AS pos, CASE WHEN max(near) = 1 THEN 0.5E0 ELSE 0.45E0 END AS confidence FROM (SELECT w.doc_id, t.frame_id, w.pos, w.near, count(*) OVER (PARTITION BY w.doc_id, t.frame_id) AS same FROM (SELECT doc_id, pos, word, max(CASE WHEN word IN ('the', 'der', 'que', 'le') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM word) w JOIN frame_trigger t ON w.word = t.trigger JOIN cascade_member m ON m.frame_id = t.frame_id) x WHERE same < 2 AND near = 1 GROUP BY doc_id, frame_id",
    "set_similarity": "SELECT a, b, CASE WHEN n_a + n_b = n_both THEN 0E0 ELSE round(n_both / (n_a + n_b - n_both), 6) END AS jaccard FROM (SELECT x.frame_id AS a, y.frame_id AS b, (SELECT count(*) FROM wide_ground g JOIN wide_ground h ON g.ground = h.ground WHERE g.frame_id = x.frame_id AND h.frame_id = y.frame_id) AS n_both, (SELECT count(*) FROM wide_ground g WHERE g.frame_id = x.frame_id) AS n_a, (SELECT count(*) FROM wide_ground g WHERE g.frame_id = y.frame_id) AS n_b FROM (SELECT DISTINCT frame_id FROM wide_ground) x JOIN (SELECT DISTINCT frame_id FROM wide_ground) y ON x.frame_id < y.frame_id) z",
    # ontology
    "frame_rank": "SELECT doc_id, frame_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS rank FROM (SELECT h.doc_id, h.frame_id, count(*) AS n, min(f.ord) AS ord FROM hit h JOIN frame_spec f ON f.frame_id = h.frame_id GROUP BY h.doc_id, h.frame_id) x",
    "frame_cascade": "SELECT f.frame_id, m.cascade_id FROM wide_spec f LEFT JOIN wide_member m ON m.frame_id = f.frame_id",
    "match_frame": "SELECT s, t, frame_id FROM (SELECT p.s, p.t, f.frame_id, row_number() OVER (PARTITION BY p.s, p.t ORDER BY CASE WHEN f.target_domain = p.t THEN 0 ELSE 1 END, f.ord) AS r FROM wide_asked p LEFT JOIN wide_spec f ON f.source_domain = p.s) x WHERE r = 1",
    "fuzzy_bind": "SELECT s, t, frame_id FROM (SELECT p.s, p.t, f.frame_id, row_number() OVER (PARTITION BY p.s, p.t ORDER BY length(f.source_domain) + CASE WHEN contains(p.t, f.target_domain) OR contains(f.target_domain, p.t) THEN length(f.target_domain) ELSE 0 END DESC, f.ord) AS r FROM (VALUES ('Theirs', 'motion'), ('Onto', 'was'), ('Dermis', 'und so'), ('Quello', 'was'), ('zzz', 'was')) AS p(s, t) JOIN wide_spec f ON contains(p.s, f.source_domain) OR contains(f.source_domain, p.s)) x WHERE r = 1",
    "bind_cascade": "SELECT p.s, p.t, coalesce(e.frame_id, o.frame_id, 'F_LLM_' || substr(md5(concat(p.s, '|', p.t)), 1, 8)) AS frame_id FROM wide_asked p LEFT JOIN wide_spec e ON e.source_domain = p.s AND e.target_domain = p.t LEFT JOIN (SELECT source_domain, min_by(frame_id, ord) AS frame_id FROM wide_spec GROUP BY source_domain) o ON o.source_domain = p.s",
    "cascade_by_target": "SELECT 'C_TARGET_' || substr(md5(concat('target||', k)), 1, 8) AS cascade_id, k AS name, @JOINED(frame_id)@ AS members FROM (SELECT coalesce(nullif(target_domain, ''), '-') AS k, frame_id FROM wide_spec) x GROUP BY k",
    "cascade_by_source": "SELECT 'C_SOURCE_' || substr(md5(concat('source||', k)), 1, 8) AS cascade_id, k AS name, @JOINED(frame_id)@ AS members FROM (SELECT coalesce(nullif(source_domain, ''), '-') AS k, frame_id FROM wide_spec) x GROUP BY k",
    "cascade_by_type": "SELECT 'C_TYPE_' || substr(md5(concat('type||', k)), 1, 8) AS cascade_id, k AS name, @JOINED(frame_id)@ AS members FROM (SELECT coalesce(nullif(source_type, ''), '-') AS k, frame_id FROM wide_spec) x GROUP BY k",
    "cascade_keep_seeds": "SELECT cascade_id, frame_id FROM wide_member WHERE cascade_id NOT LIKE 'C_LLM_%' UNION ALL SELECT 'C_NEW_' || substr(md5(target_domain), 1, 8), frame_id FROM wide_spec f WHERE NOT EXISTS (SELECT 1 FROM wide_member m WHERE m.frame_id = f.frame_id AND m.cascade_id NOT LIKE 'C_LLM_%')",
    "cascade_stats": "SELECT count(*) AS n_cascades, avg(n) AS mean_size, max(n) AS max_size, @PERCENTILE(n;0.5)@ AS median_size, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 6) AS singleton_rate, round(sum(n) / (SELECT count(*) FROM wide_spec), 6) AS coverage FROM (SELECT cascade_id, count(*) AS n FROM wide_member GROUP BY cascade_id) x",
    "ontology_merge": "SELECT frame_id, origin, support FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY prio) AS r FROM (SELECT frame_id, 'base' AS origin, support, 0 AS prio FROM wide_spec UNION ALL SELECT concat('F_', substr(md5(concat(s, '||', t)), 1, 16)), 'new', n, 1 FROM wide_asked) u) x WHERE r = 1",
    "generic_triggers": "SELECT trigger, n FROM (SELECT t.trigger, count(DISTINCT concat(f.source_domain, '|', f.target_domain)) AS n FROM wide_trigger t JOIN wide_spec f ON f.frame_id = t.frame_id GROUP BY t.trigger) x WHERE length(trigger) >= 2 AND n <= 1",
    "self_loops_removed": "SELECT frame_id FROM wide_spec WHERE source_domain <> target_domain",
    "ontology_core": "SELECT f.frame_id, m.cascade_id FROM wide_spec f LEFT JOIN wide_member m ON m.frame_id = f.frame_id WHERE f.support >= 2",
    # extraction and guards
    "type_guard": "SELECT f.frame_id FROM wide_spec f WHERE EXISTS (SELECT 1 FROM type_constraint c WHERE c.source_type = f.source_type AND c.mapping_type = f.mapping_type)",
    "literal_guard": "SELECT h.doc_id, h.frame_id FROM (SELECT DISTINCT doc_id, frame_id FROM hit) h WHERE NOT EXISTS (SELECT 1 FROM hit x JOIN stop_word s ON x.trigger = s.word JOIN frame_spec f ON f.frame_id = x.frame_id WHERE x.doc_id = h.doc_id AND x.frame_id = h.frame_id AND s.exempt <> f.source_domain)",
    "l1_edges": "SELECT edge_id, doc_id, frame_id, cascade_id, n_triggers, confidence, CASE WHEN n_triggers = 1 THEN 'novel' ELSE 'conventional' END AS novelty FROM edge WHERE confidence >= 0.35",
    "refine_tristate": "SELECT e.edge_id, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'metaphor' ELSE 'rejected' END AS verdict FROM edge e LEFT JOIN labels l ON l.doc_id = e.doc_id",
    "missing_keys": "SELECT count(*) AS n_missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "edge_dedup": "SELECT doc_id, source_type, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_type ORDER BY ord) AS r FROM edge) x WHERE r = 1",
    "confusion_p1": "SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS p, round(tp / nullif(tp + fn, 0), 6) AS r, round(fp / nullif(fp + tn, 0), 6) AS p1 FROM (SELECT count(*) FILTER (WHERE y = 1 AND e) AS tp, count(*) FILTER (WHERE y = 0 AND e) AS fp, count(*) FILTER (WHERE y = 1 AND NOT e) AS fn, count(*) FILTER (WHERE y = 0 AND NOT e) AS tn FROM (SELECT l.quality AS y, x.doc_id IS NOT NULL AS e FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM edge WHERE n_triggers > 1) x ON x.doc_id = l.doc_id) z) w",
    # linking
    "chain_pairs": "SELECT a.edge_id AS a, b.edge_id AS b FROM edge a JOIN beside b ON a.frame_id = b.frame_id AND a.doc_id = b.spot AND a.doc_id <> b.doc_id WHERE a.n_ground >= 1",
    "span_gap": "SELECT a.edge_id AS a, b.edge_id AS b, min(abs(a.doc_id - b.doc_id)) AS gap FROM edge a JOIN beside b ON a.cascade_id = b.cascade_id AND a.doc_id = b.spot AND a.edge_id < b.edge_id GROUP BY a.edge_id, b.edge_id",
    "frames_l2": "SELECT frame_id, count(*) AS n_members, min(edge_id) AS first_member FROM edge GROUP BY frame_id",
    "cascades_l3": "SELECT m.cascade_id, count(DISTINCT e.frame_id) AS n_frames, count(e.edge_id) AS n_edges FROM cascade_member m JOIN edge e ON e.frame_id = m.frame_id GROUP BY m.cascade_id",
    "orphan_cascades": "SELECT 'C_ADHOC_' || substr(md5(source_domain), 1, 8) AS cascade_id, @JOINED(frame_id)@ AS members FROM wide_spec f WHERE NOT EXISTS (SELECT 1 FROM wide_member m WHERE m.frame_id = f.frame_id) GROUP BY source_domain",
    "cache_counts": "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_hit, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_miss FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    # graph
    "incidence": "SELECT edge, node FROM incidence",
    "graph_density": "SELECT count(*) AS total, count(DISTINCT node) AS n_nodes, round(count(*) / count(DISTINCT node), 6) AS density FROM incidence",
    "graph_health": "SELECT n_edges, n_nodes, round(total / n_edges, 6) AS avg_arity, round(total / n_nodes, 6) AS density, round(n_orphan / n_nodes, 6) AS orphan_rate, max_degree FROM (SELECT (SELECT count(DISTINCT edge) FROM incidence) AS n_edges, count(*) AS n_nodes, sum(deg) AS total, sum(CASE WHEN deg <= 1 THEN 1 ELSE 0 END) AS n_orphan, max(deg) AS max_degree FROM (SELECT node, count(*) AS deg FROM incidence GROUP BY node) d) x",
    "hierarchy_coverage": "SELECT round(least(fc, cc), 6) AS hierarchy, fc, cc FROM (SELECT (SELECT count(frame_id) / count(*) FROM edge) AS fc, (SELECT count(cascade_id) / count(*) FROM edge) AS cc) x",
    "centrality": "SELECT edge_id, 0.5E0 * n_ground + CASE WHEN cascade_id IS NOT NULL THEN 0.5E0 ELSE 0E0 END AS centrality FROM edge",
    "operator_rowsum": "SELECT node, round(sum(share), 6) AS rowsum FROM (SELECT a.node, b.node AS other, sum(1E0 / (d.deg * s.size)) AS share FROM incidence a JOIN incidence b ON a.edge = b.edge JOIN (SELECT node, count(*) AS deg FROM incidence GROUP BY node) d ON d.node = a.node JOIN (SELECT edge, count(*) AS size FROM incidence GROUP BY edge) s ON s.edge = a.edge GROUP BY a.node, b.node) x GROUP BY node",
    "comembers": "SELECT a.node, count(DISTINCT b.node) AS n_others FROM incidence a JOIN incidence b ON a.edge = b.edge AND a.node <> b.node GROUP BY a.node",
    "node_edge_mean": "SELECT edge, round(avg(p_retailprice), 6) AS mean_price FROM incidence i JOIN part p ON p.p_partkey = i.node GROUP BY edge",
    # retrieval
    "cross_domain": "SELECT query_id, doc_id, score, rank FROM lap WHERE rank <= 10",
    "literal_path": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "multi_clue": "SELECT target_domain, round(sum(confidence), 6) AS clue FROM edge e JOIN frame_trigger t ON t.frame_id = e.frame_id GROUP BY target_domain HAVING sum(confidence) >= 2 * 0.35E0",
    "rrf": "SELECT query_id, doc_id, round(sum(1E0 / (60 + rank)), 6) AS fused FROM (SELECT query_id, doc_id, rank FROM lap WHERE rank <= 50 UNION ALL SELECT q.query_id, d.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id) FROM query_set q JOIN documents d ON contains(d.text, q.query_text)) x GROUP BY query_id, doc_id",
    "reliability": "SELECT edge_id, 0.5E0 + 0.5E0 * least(confidence, CASE WHEN registered = 1 THEN 1E0 ELSE 0.5E0 END) AS factor FROM (SELECT e.edge_id, e.confidence, CASE WHEN f.support >= 2 THEN 1 ELSE 0 END AS registered FROM edge e JOIN frame_spec f ON f.frame_id = e.frame_id) x",
    "pair_features": "SELECT a.edge_id AS q, b.edge_id AS c, CASE WHEN a.source_domain = b.source_domain THEN 1 ELSE 0 END AS same_source, CASE WHEN a.target_domain = b.target_domain THEN 1 ELSE 0 END AS same_target, CASE WHEN a.frame_id = b.frame_id THEN 1 ELSE 0 END AS same_frame, CASE WHEN a.cascade_id = b.cascade_id THEN 1 ELSE 0 END AS same_cascade, round(ln(1 + a.n_ground), 6) AS ground_log, b.confidence FROM edge a JOIN beside b ON a.doc_id = b.spot AND a.edge_id <> b.edge_id",
    "hand_score": "SELECT q, c, round(0.4E0 * same_frame + 0.3E0 * same_cascade + 0.2E0 * same_target + 0.1E0 * same_source, 4) AS score FROM (SELECT a.edge_id AS q, b.edge_id AS c, CASE WHEN a.source_domain = b.source_domain THEN 1 ELSE 0 END AS same_source, CASE WHEN a.target_domain = b.target_domain THEN 1 ELSE 0 END AS same_target, CASE WHEN a.frame_id = b.frame_id THEN 1 ELSE 0 END AS same_frame, CASE WHEN a.cascade_id = b.cascade_id THEN 1 ELSE 0 END AS same_cascade FROM edge a JOIN beside b ON a.doc_id = b.spot AND a.edge_id <> b.edge_id) x",
    "u_retrieval": "SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.query_id, e.doc_id, round(sum(CASE WHEN contains(q.query_text, e.target_domain) THEN 0.5E0 ELSE 0E0 END + CASE WHEN contains(q.query_text, e.source_domain) THEN 0.3E0 ELSE 0E0 END), 6) AS score FROM query_set q JOIN edge e ON contains(q.query_text, e.target_domain) OR contains(q.query_text, e.source_domain) GROUP BY q.query_id, e.doc_id) x) y WHERE r <= 60",
    "pathways": "SELECT query_id, path, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT query_id, doc_id, 'cascade' AS path FROM lap UNION ALL SELECT q.query_id, d.doc_id, 'literal' FROM query_set q JOIN documents d ON contains(d.text, q.query_text)) x GROUP BY query_id, path",
    # signals
    "omega": "SELECT query_id, n_frames, n_emergent, round(exp((ln(greatest(least(1E0, n_frames / 3E0), 0.001E0)) + ln(greatest(least(1E0, n_emergent / 3E0), 0.001E0))) / 2), 6) AS omega FROM (SELECT r.query_id, r.n_emergent, f.n_frames FROM (SELECT query_id, count(*) AS n_emergent FROM wide_q_reach GROUP BY query_id) r JOIN (SELECT query_id, count(*) AS n_frames FROM wide_q_frame GROUP BY query_id) f ON f.query_id = r.query_id) x",
    "query_signal": "SELECT query_id, n_direct, n_reach, round(ln(1E0 + n_reach) * (1E0 - n_direct / (1E0 + n_reach)), 6) AS signal FROM (SELECT r.query_id, r.n_reach, d.n_direct FROM (SELECT query_id, count(*) AS n_reach FROM wide_q_reach GROUP BY query_id) r JOIN (SELECT q.query_id, count(DISTINCT f.target_domain) AS n_direct FROM wide_q_frame q JOIN wide_spec f ON f.frame_id = q.frame_id GROUP BY q.query_id) d ON d.query_id = r.query_id) x",
    "new_domains": "SELECT query_id, domain FROM wide_q_reach EXCEPT SELECT q.query_id, f.target_domain FROM wide_q_frame q JOIN wide_spec f ON f.frame_id = q.frame_id",
    "gate": "SELECT query_id FROM (SELECT query_id, count(*) AS n FROM wide_q_reach GROUP BY query_id) x WHERE n >= 4",
    "stratified_z": "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / coalesce(nullif(stddev_samp(value) OVER (PARTITION BY event_type), 0), stddev_samp(value) OVER (PARTITION BY 1)), 4) AS z FROM events",
    # evaluation
    "mrr_hits_recall": "SELECT round(avg(rr), 6) AS mrr, round(avg(h10), 6) AS hits10, round(avg(rec), 6) AS recall10 FROM (SELECT l.query_id, coalesce(max(CASE WHEN g.quality = 1 THEN 1E0 / l.rank END), 0E0) AS rr, max(CASE WHEN g.quality = 1 AND l.rank <= 10 THEN 1E0 ELSE 0E0 END) AS h10, sum(CASE WHEN g.quality = 1 AND l.rank <= 10 THEN 1E0 ELSE 0E0 END) / nullif(sum(CASE WHEN g.quality = 1 THEN 1 ELSE 0 END), 0) AS rec FROM lap l LEFT JOIN labels g ON g.doc_id = l.doc_id GROUP BY l.query_id) x",
    "random_baseline": "SELECT n, round(1E0 - exp(s), 6) AS hits10 FROM (SELECT (SELECT count(*) FROM labels) AS n, sum(ln((t.n - t.g - i + 1) / CAST(t.n - i + 1 AS DOUBLE))) AS s FROM (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS g FROM labels) t CROSS JOIN @SERIES(10)@ z) x",
    "kappa": "SELECT round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS raw FROM (SELECT avg(CASE WHEN quality = toxic THEN 1E0 ELSE 0E0 END) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels) x",
    "source_rollup": "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n_docs, sum(n_chars) AS n_chars FROM documents GROUP BY ROLLUP(source)",
    "holdout_split": "SELECT CASE WHEN floor(doc_id / 10) % 2 = 0 THEN 'tune' ELSE 'report' END AS part, count(*) AS n FROM documents GROUP BY CASE WHEN floor(doc_id / 10) % 2 = 0 THEN 'tune' ELSE 'report' END",
    # learning and statistics
    "avg_rank": "SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2E0 AS r FROM documents",
    "feature_auc": "SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - np * (np + 1) / 2E0) / (np * nn), 6) AS auc FROM (SELECT y, r, sum(y) OVER () AS np, sum(1 - y) OVER () AS nn FROM (SELECT l.quality AS y, rank() OVER (ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.n_chars) - 1) / 2E0 AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x) z GROUP BY np, nn",
    "separators": "SELECT quality, min(n_chars) AS lo, max(n_chars) AS hi FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY quality",
    "spearman": "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2E0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2E0 AS b FROM part) x",
    "pearson": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem",
    "mann_whitney": "SELECT np, nn, round(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - np * (np + 1) / 2E0, 4) AS u FROM (SELECT y, r, sum(y) OVER () AS np, sum(1 - y) OVER () AS nn FROM (SELECT l.toxic AS y, rank() OVER (ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.n_chars) - 1) / 2E0 AS r FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x) z GROUP BY np, nn",
    "quantiles": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(@PERCENTILE(value;0.25)@, 4) AS q25, round(@PERCENTILE(value;0.5)@, 4) AS q50, round(@PERCENTILE(value;0.75)@, 4) AS q75, round(avg(CASE WHEN value = 0 THEN 1E0 ELSE 0E0 END), 6) AS zero_frac FROM events GROUP BY event_type",
    "holm": "SELECT k, least(1E0, max((m - i + 1) * p) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT k, p, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM (SELECT l_suppkey AS k, round(avg(l_discount) / 20, 9) AS p FROM lineitem GROUP BY l_suppkey) t) x",
    "mcnemar": "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM labels",
    "bootstrap_ci": "SELECT @PERCENTILE(m;0.025)@ AS lo, @PERCENTILE(m;0.975)@ AS hi FROM (SELECT i, round(avg(x.y), 9) AS m FROM (SELECT s.i, d.y FROM @SERIES(2000)@ s CROSS JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) p JOIN (SELECT quality AS y, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) d ON d.k = @HEX(concat(s.i, '|', p.k);1;7)@ % (SELECT count(*) FROM labels)) x GROUP BY i) b",
    "permutation_p": "SELECT round((1 + sum(CASE WHEN abs(m) >= abs(t) THEN 1 ELSE 0 END)) / (1E0 + count(*)), 6) AS p FROM (SELECT z.i, avg(CASE WHEN z.y = 1 THEN z.v END) - avg(CASE WHEN z.y = 0 THEN z.v END) AS m FROM (SELECT a.i, a.y, b.v FROM (SELECT s.i, l.toxic AS y, row_number() OVER (PARTITION BY s.i ORDER BY md5(concat(s.i, '|', l.doc_id)), l.doc_id) AS k FROM labels l CROSS JOIN @SERIES(1000)@ s) a JOIN (SELECT d.n_chars AS v, row_number() OVER (ORDER BY l.doc_id) AS k FROM labels l JOIN documents d ON d.doc_id = l.doc_id) b ON a.k = b.k) z GROUP BY z.i) r CROSS JOIN (SELECT avg(CASE WHEN toxic = 1 THEN n_chars END) - avg(CASE WHEN toxic = 0 THEN n_chars END) AS t FROM labels l JOIN documents d ON d.doc_id = l.doc_id) o",
    # governance
    "evidence_merge": "SELECT user_id, event_type, count(*) AS n, min(event_id) AS kept FROM events GROUP BY user_id, event_type",
    "conflict_authority": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY a DESC, event_type) AS r FROM (SELECT user_id, event_type, round(avg(value), 6) AS a FROM events GROUP BY user_id, event_type) x) y WHERE r = 1",
    "conflict_recent": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_type) AS r FROM (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY user_id, event_type) x) y WHERE r = 1",
    "conflict_vote": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) x) y WHERE r = 1",
    "conflict_hybrid": "SELECT user_id, event_type, score FROM (SELECT user_id, event_type, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS r FROM (SELECT user_id, event_type, round(a * power(0.5E0, age / 30E0) * ln(1 + n), 5) AS score FROM (SELECT user_id, event_type, avg(value) AS a, count(*) AS n, @DAYS(max(CAST(ts AS DATE));DATE '2024-02-01')@ AS age FROM events GROUP BY user_id, event_type) x) y) z WHERE r = 1",
    "trigger_lift": "SELECT trigger, round((dm / nm) / (dn / nn + 0.000001E0), 4) AS lift FROM (SELECT h.trigger, count(DISTINCT CASE WHEN l.quality = 1 THEN l.doc_id END) AS dm, count(DISTINCT CASE WHEN l.quality = 0 THEN l.doc_id END) AS dn FROM hit h JOIN labels l ON l.doc_id = h.doc_id GROUP BY h.trigger) x CROSS JOIN (SELECT count(*) FILTER (WHERE quality = 1) AS nm, count(*) FILTER (WHERE quality = 0) AS nn FROM labels) y",
    "pair_agg": "SELECT source_domain, target_domain, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM edge WHERE confidence >= 0.6 GROUP BY source_domain, target_domain",
    "tiering": "SELECT frame_id, n, CASE WHEN n >= 100 THEN 'core' ELSE 'longtail' END AS tier FROM (SELECT frame_id, count(*) AS n FROM edge GROUP BY frame_id) x",
    "island_labels": "SELECT user_id, island, min(event_id) AS first_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS label FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events) x) y GROUP BY user_id, island",
    "seeded_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42|', doc_id)), doc_id) AS r FROM documents) x WHERE r <= 20",
    # sinks and templates
    "label_counts": "SELECT 'Frame' AS label, count(*) AS n FROM frame_spec UNION ALL SELECT 'Cascade', count(DISTINCT cascade_id) FROM cascade_member UNION ALL SELECT 'Edge', count(*) FROM edge",
    "cypher_rows": "SELECT concat('MERGE (e:Edge {id: ''', edge_id, '''}) SET e.confidence = ', CAST(CAST(confidence * 1000 AS INT) AS VARCHAR(10))) AS statement FROM edge",
    "tpl_cross_domain": "SELECT e.doc_id, e.edge_id, e.confidence FROM (SELECT e.*, row_number() OVER (ORDER BY confidence DESC, edge_id) AS r FROM edge e JOIN cascade_member a ON a.frame_id = e.frame_id WHERE a.cascade_id IN (SELECT m.cascade_id FROM cascade_member m JOIN frame_spec f ON f.frame_id = m.frame_id WHERE f.source_domain = 'to') AND e.target_domain = 'tion') e WHERE r <= 10",
    "tpl_targets": "SELECT target_domain, count(*) AS support FROM edge WHERE source_domain IN ('to', 'of the', 'is') GROUP BY target_domain",
    "tpl_drilldown": "SELECT m.cascade_id, e.frame_id, e.source_domain, e.target_domain, count(*) AS n FROM cascade_member m JOIN edge e ON e.frame_id = m.frame_id GROUP BY m.cascade_id, e.frame_id, e.source_domain, e.target_domain",
    "tpl_shared_ground": "SELECT x.frame_id AS a, y.frame_id AS b, count(*) AS n FROM wide_ground x JOIN wide_ground y ON x.ground = y.ground AND x.frame_id <> y.frame_id GROUP BY x.frame_id, y.frame_id",
    "tpl_evidence": "SELECT user_id, count(*) AS support, round(avg(value), 4) AS authority, max(ts) AS latest FROM events GROUP BY user_id",
    # reranking
    "superset_union": "SELECT doc_id, round(0.5E0 * mx + 0.25E0 * mean + 0.25E0 * least(1E0, 20 * rr) + least(0.05E0 * (n - 1), 0.2E0), 5) AS score FROM (SELECT doc_id, max(s) AS mx, avg(s) AS mean, sum(1E0 / (60 + r)) AS rr, count(*) AS n FROM (SELECT doc_id, query_id, rank AS r, CASE WHEN max(score) OVER w - min(score) OVER w < 0.000000001E0 THEN 1E0 / rank ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lap WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)) x GROUP BY doc_id) y",
    "path_geometry": "SELECT user_id, count(*) AS steps, round(avg(sqrt(abs(value * nxt))), 4) AS potential, sum(CASE WHEN nxt >= value THEN 1 ELSE 0 END) AS forward FROM (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) x WHERE nxt IS NOT NULL GROUP BY user_id",
    # over many documents 1 - exp(sum) is 1 for every frame, so minus the sum itself is compared
    "anchors": "SELECT frame_id, round(-sum(ln(1 - 0.5E0 * confidence)), 6) AS strength FROM edge GROUP BY frame_id",
}

#: Twins written apart, where the shared text is planned as a nested loop.
TWINS: dict[str, str] = {
    "bootstrap_ci": """WITH d AS MATERIALIZED (SELECT quality AS y, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels), n AS (SELECT count(*) AS n FROM labels),
      draw AS MATERIALIZED (SELECT i, ('0x' || substr(md5(concat(i, '|', k)), 1, 7))::BIGINT % n AS k FROM range(1, 2001) r(i), d, n)
      SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT i, round(avg(y), 9) AS m FROM draw JOIN d ON d.k = draw.k GROUP BY i) x""",
}

#: Registered in ``testing`` and ``folded`` with operators of their own for Spark; the SQL is the one here.
APART = ("bootstrap_ci", "permutation_p", "stratified_z", "comembers")


def sql_of(name: str) -> str:
    return TWINS.get(name) or duck(TEXTS[name])


for _name, _text in TEXTS.items():
    if _name in APART:
        continue
    plan(_name, sql_of(_name))(lambda spark, sf_dir, text=_text: run(spark, sf_dir, text))
