"""DuckDB SQL for the queries of the catalogue, written from the definitions and not from the plans."""

from __future__ import annotations

_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "inter": ((), "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, value AS rating, epoch_us(ts) AS timestamp FROM events"),
    "rated": (("inter",), "SELECT *, CAST(CASE WHEN rating IS NULL OR isnan(rating) THEN 1 WHEN rating >= 40 THEN 3 WHEN rating >= 15 THEN 2 ELSE 1 END AS INTEGER) AS feedback_id FROM inter"),
    "ex": (
        ("rated",),
        """SELECT CASE WHEN total = upto THEN 'test' WHEN total - upto = 1 THEN 'valid' WHEN position > 0 THEN 'train' END AS split, user_id,
             coalesce(h, []) AS history_item_ids, coalesce(f, []) AS history_feedback_ids, coalesce(p, []) AS positive_history_item_ids,
             item_id AS target_item_id, timestamp AS target_timestamp, CAST(len(coalesce(h, [])) AS BIGINT) AS history_length
           FROM (SELECT *, row_number() OVER u - 1 AS position, sum(CASE WHEN feedback_id = 3 THEN 1 ELSE 0 END) OVER u AS upto,
                   sum(CASE WHEN feedback_id = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS total,
                   list(item_id) OVER b AS h, list(CAST(feedback_id AS BIGINT)) OVER b AS f, list(item_id) FILTER (WHERE feedback_id = 3) OVER b AS p
                 FROM rated WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, item_id, rating),
                   b AS (PARTITION BY user_id ORDER BY timestamp, item_id, rating ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
           WHERE feedback_id = 3 AND total >= 5 AND (total - upto < 2 OR position > 0)""",
    ),
    "train": (("ex",), "SELECT * FROM ex WHERE split = 'train'"),
    "asked": (("ex",), "SELECT user_id AS query_id, history_item_ids AS history, positive_history_item_ids AS past, target_item_id AS target FROM ex WHERE split = 'test'"),
    "pop": (("train",), "SELECT target_item_id AS item_id, count(*) AS item_count, row_number() OVER (ORDER BY count(*) DESC, target_item_id) AS item_rank FROM train GROUP BY 1"),
    "pop_rec": (("asked", "pop"), "SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_rank) AS rank FROM asked, pop WHERE NOT list_contains(history, item_id)) WHERE rank <= 20"),
    "edge": (("train",), "SELECT unnest(positive_history_item_ids[-50:]) AS source_item_id, target_item_id FROM train"),
    "pairs": (
        ("train",),
        "SELECT source_item_id, target_item_id, count(*) AS pair_count FROM (SELECT unnest(list_distinct(positive_history_item_ids[-50:])) AS source_item_id, target_item_id FROM train) WHERE source_item_id <> target_item_id GROUP BY ALL",
    ),
    "nbr": (
        ("pairs", "pop"),
        """SELECT * FROM (SELECT source_item_id, target_item_id, pair_count, row_number() OVER (PARTITION BY source_item_id
             ORDER BY pair_count DESC, coalesce(item_rank, 9223372036854775807), target_item_id) AS candidate_rank
           FROM pairs LEFT JOIN pop ON target_item_id = item_id) WHERE candidate_rank <= 20""",
    ),
    "knn_rec": (
        ("asked", "nbr", "pop"),
        """SELECT query_id, rank, item_id FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score IS NULL, score DESC, item_rank, item_id) AS rank
           FROM (SELECT a.query_id, i.item_id, s.score, coalesce(p.item_rank, (SELECT count(*) + 1 FROM pop)) AS item_rank
                 FROM asked a CROSS JOIN (SELECT item_id FROM pop UNION SELECT target_item_id FROM nbr) i LEFT JOIN pop p ON i.item_id = p.item_id
                 LEFT JOIN (SELECT query_id, target_item_id, sum(pair_count) AS score FROM (SELECT query_id, unnest(past[-50:]) AS source_item_id FROM asked) JOIN nbr USING (source_item_id) GROUP BY ALL) s
                   ON s.query_id = a.query_id AND s.target_item_id = i.item_id
                 WHERE NOT list_contains(a.past, i.item_id) AND (s.score IS NOT NULL OR p.item_id IS NOT NULL))) WHERE rank <= 20""",
    ),
    "listed": (("ex",), "SELECT user_id, history_item_ids[-12:] AS rec, list_distinct(positive_history_item_ids[-6:]) AS relevant FROM ex WHERE split = 'valid'"),
    "places": (("listed",), "SELECT user_id, item, min(place) AS place FROM (SELECT user_id, unnest(rec) AS item, generate_subscripts(rec, 1) AS place, relevant FROM listed) WHERE list_contains(relevant, item) GROUP BY ALL"),
    "universe": (("train",), "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT target_item_id AS item_id FROM train UNION SELECT unnest(positive_history_item_ids) FROM train)"),
    "counts": (
        ("universe", "edge", "train"),
        """SELECT u.item_id, item_idx, coalesce(t.n, 0) AS target_count, coalesce(s.n, 0) AS source_count FROM universe u
           LEFT JOIN (SELECT target_item_id AS item_id, count(*) AS n FROM train GROUP BY 1) t ON u.item_id = t.item_id
           LEFT JOIN (SELECT source_item_id AS item_id, count(*) AS n FROM edge GROUP BY 1) s ON u.item_id = s.item_id""",
    ),
    "proj": (
        ("edge",),
        """SELECT target_item_id AS item_id,
             CAST((CAST(source_item_id AS HUGEINT) * 11400714819323198485 + 42 + 2654435761) % 18446744073709551616 % 8 AS BIGINT) AS bucket,
             CAST(sum(CASE WHEN (source_item_id + 42 + 2246822507) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS weight
           FROM edge WHERE source_item_id <> target_item_id GROUP BY ALL""",
    ),
    "codec0": (
        ("inter",),
        "SELECT item_id, [CAST(p // 25 % 5 AS INTEGER), CAST(p // 5 % 5 AS INTEGER), CAST(p % 5 AS INTEGER)] AS semantic_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM (SELECT DISTINCT item_id FROM inter))",
    ),
    "codec": (("codec0",), "SELECT * FROM codec0"),
    "vocab": (("codec",), "SELECT item_id, row_number() OVER (ORDER BY item_id) + 1 AS item_idx FROM codec"),
    "nodes": (
        ("codec",),
        "SELECT level, prefix, is_terminal, row_number() OVER (ORDER BY level, prefix) - 1 AS state FROM (SELECT DISTINCT l AS level, semantic_id[1:l] AS prefix, l = 3 AS is_terminal FROM codec, range(0, 4) r(l))",
    ),
    "links": (("nodes",), "SELECT a.level, a.state, b.prefix[b.level] AS token, b.state AS next_state FROM nodes b JOIN nodes a ON b.level = a.level + 1 AND b.prefix[1:a.level] = a.prefix"),
    "toks": ((), "SELECT t FROM range(0, 5) r(t)"),
}

#: The decoder's deterministic logits for a query, a code of the prefix and a token.
_LOGIT = "((query_id * 17 + ({code}) * 13 + {t} * 29) % 101) / 20.0"
_CODES = ["7", "(7 * 31 + a0 + 1) % 1009", "((7 * 31 + a0 + 1) % 1009 * 31 + a1 + 1) % 1009"]


def _search(masked: bool, tag: str, width: str = "10") -> list[tuple[str, str]]:
    """Three levels of the beam search, unrolled."""
    out = []
    before = "(SELECT query_id, CAST(0 AS BIGINT) AS state, 0.0::DOUBLE AS s FROM asked)"
    names: list[str] = []
    for step in range(3):
        cols = "".join(f", b.{a}" for a in names)
        logit = _LOGIT.format(code=_CODES[step], t="t")
        over = f"{before} b, toks" if not masked else f"{before} b JOIN (SELECT state, token AS t FROM links WHERE level = {step}) k ON k.state = b.state"
        z = f"SELECT query_id{cols.replace('b.', '')}, ln(sum(exp({logit}))) AS z FROM {over} GROUP BY ALL"
        using = ", ".join(["query_id", *names])
        pick = f"SELECT b.query_id{cols}, l.token AS a{step}, l.next_state AS state, b.s + {_LOGIT.format(code=_CODES[step], t='l.token')} - z AS s FROM {before} b JOIN z{tag}{step} USING ({using}) JOIN links l ON l.state = b.state AND l.level = {step}"
        names.append(f"a{step}")
        out.append((f"z{tag}{step}", z))
        out.append((f"b{tag}{step}", f"SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, {', '.join(names)}) AS r FROM ({pick})) p JOIN asked USING (query_id) WHERE r <= {width}"))
        before = f"b{tag}{step}"
    out.append((f"beams{tag}", f"SELECT query_id, r AS beam_rank, [a0, a1, a2] AS semantic_id, s AS log_score FROM b{tag}2"))
    return out


for _masked, _tag, _width in ((False, "f", "10"), (True, "m", "10"), (False, "w", "greatest(10, 5 + len(list_distinct(history)))")):
    _last: tuple[str, ...] = ("asked", "links", "toks")
    for _name, _sql in _search(_masked, _tag, _width):
        _STEPS[_name] = (_last, _sql)
        _last = (*_last, _name)

_FOUND = """SELECT *, sum(CASE WHEN status = 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY beam_rank) AS kept FROM (
         SELECT *, CASE WHEN item_id IS NULL THEN 'invalid' WHEN list_contains(history, item_id) THEN 'history'
           WHEN row_number() OVER (PARTITION BY query_id, item_id ORDER BY beam_rank) > 1 THEN 'duplicate' ELSE 'kept' END AS status
         FROM {beams} LEFT JOIN codec USING (semantic_id) JOIN asked USING (query_id))"""
_GEN = "SELECT query_id, beam_rank, item_id, semantic_id, kept AS rank, CASE WHEN kept > 5 OR (kept = 5 AND status <> 'kept') THEN 'unread' ELSE status END AS status FROM {found}"
for _found, _gen, _beams in (("found", "gen", "beamsf"), ("foundw", "genw", "beamsw")):
    _STEPS[_found] = ((_beams, "codec", "asked"), _FOUND.format(beams=_beams))
    _STEPS[_gen] = ((_found,), _GEN.format(found=_found))


def _with(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in _STEPS[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_STEPS[n][1]})" for n in order) + "\n" + select if order else select


def _j(*names: str) -> str:
    return ", ".join(f"array_to_string({n}, ',') AS {n}" for n in names)


_SPLIT = f"SELECT user_id, {_j('history_item_ids', 'history_feedback_ids', 'positive_history_item_ids')}, target_item_id, target_timestamp, history_length FROM ex WHERE split = '{{}}'"


def _mean(rec: str, cutoffs: str) -> str:
    """One relevant item for a query, at the place that ``rec`` gives it."""
    return f"""SELECT CAST(k AS BIGINT) AS k, count(*) AS n_queries, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 0), 6) AS recall,
      round(coalesce(avg(CASE WHEN rank <= k THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 0), 6) AS ndcg, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0 / rank ELSE 0.0 END), 0), 6) AS mrr
    FROM (SELECT a.query_id, r.rank FROM asked a LEFT JOIN {rec} r ON r.query_id = a.query_id AND r.item_id = a.target), (VALUES {cutoffs}) c(k) GROUP BY k"""


_EACH = """SELECT user_id, k, (SELECT count(*) FROM places p WHERE p.user_id = l.user_id AND place <= k) * 1.0 / nullif(len(relevant), 0) AS recall,
  (SELECT sum(1 / log2(place + 1)) FROM places p WHERE p.user_id = l.user_id AND place <= k) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 100) g(i) WHERE i <= least(len(relevant), k)) AS ndcg,
  1.0 / (SELECT min(place) FROM places p WHERE p.user_id = l.user_id AND place <= k) AS mrr FROM listed l, (VALUES {}) c(k)"""

ORACLE_SQL: dict[str, str] = {
    "normalize_interactions": _with("SELECT * FROM inter", "inter"),
    "feedback_tiers": _with("SELECT * FROM rated", "rated"),
    "filter_min_rating": _with("SELECT * FROM inter WHERE rating >= 40", "inter"),
    "users_min_interactions": _with("SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 65)", "inter"),
    "users_min_positive": _with("SELECT * FROM rated WHERE user_id IN (SELECT user_id FROM rated WHERE feedback_id = 3 GROUP BY 1 HAVING count(*) >= 28)", "rated"),
    "sort_interactions_rank": _with("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id, rating) - 1 AS position FROM inter", "inter"),
    "split_train": _with(_SPLIT.format("train"), "ex"),
    "split_valid": _with(_SPLIT.format("valid"), "ex"),
    "split_test": _with(_SPLIT.format("test"), "ex"),
    "split_counts": _with("SELECT split, count(*) AS n, CAST(sum(history_length) AS BIGINT) AS history_items FROM ex GROUP BY 1", "ex"),
    "preprocess_stats": _with(
        "SELECT s AS stage, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS n FROM (SELECT 'raw' AS s, * FROM rated UNION ALL SELECT 'positive', * FROM rated WHERE feedback_id = 3 "
        "UNION ALL SELECT 'eligible', * FROM rated WHERE user_id IN (SELECT user_id FROM rated WHERE feedback_id = 3 GROUP BY 1 HAVING count(*) >= 5)) GROUP BY 1",
        "rated",
    ),
    "popularity_rank": _with("SELECT * FROM pop", "pop"),
    "popularity_topk": _with("SELECT query_id, rank, item_id FROM pop_rec", "pop_rec"),
    "popularity_metrics": _with(_mean("pop_rec", "(10), (20)"), "asked", "pop_rec"),
    "cooccur_pairs": _with("SELECT * FROM pairs", "pairs"),
    "knn_neighbors": _with("SELECT * FROM nbr", "nbr"),
    "knn_recommend": _with("SELECT * FROM knn_rec", "knn_rec"),
    "knn_metrics": _with(_mean("knn_rec", "(10), (20)"), "asked", "knn_rec"),
    "recall_at_k": _with(f"SELECT user_id, round(coalesce(recall, 0), 6) AS recall FROM ({_EACH.format('(10)')})", "listed", "places"),
    "ndcg_at_k": _with(f"SELECT user_id, round(coalesce(ndcg, 0), 6) AS ndcg FROM ({_EACH.format('(10)')})", "listed", "places"),
    "mrr_at_k": _with(f"SELECT user_id, round(coalesce(mrr, 0), 6) AS mrr FROM ({_EACH.format('(10)')})", "listed", "places"),
    "metrics_multi_relevant": _with(
        f"SELECT CAST(k AS BIGINT) AS k, count(*) AS n_queries, round(avg(coalesce(recall, 0)), 6) AS recall, round(avg(coalesce(ndcg, 0)), 6) AS ndcg, round(avg(coalesce(mrr, 0)), 6) AS mrr FROM ({_EACH.format('(5), (10)')}) GROUP BY k",
        "listed",
        "places",
    ),
    "item_universe": _with("SELECT item_id, item_idx FROM universe", "universe"),
    "item_vocab": _with(
        "SELECT item_id, row_number() OVER (ORDER BY item_id) + 1 AS item_idx FROM (SELECT item_id FROM codec UNION SELECT target_item_id FROM train UNION SELECT unnest(history_item_ids) FROM train)",
        "codec",
        "train",
    ),
    "target_coverage": _with("SELECT count(*) AS total, count(item_id) AS known, count(*) - count(item_id) AS unknown, round((count(*) - count(item_id)) / count(*), 6) AS unknown_rate FROM asked LEFT JOIN codec ON target = item_id", "asked", "codec"),
    "target_coverage_limited": _with(
        "SELECT count(*) AS total, CAST(sum(k) AS BIGINT) AS known, CAST(count(*) - sum(k) AS BIGINT) AS unknown, round((count(*) - sum(k)) / count(*), 6) AS unknown_rate FROM "
        "(SELECT CASE WHEN item_id IS NULL THEN 0 ELSE 1 END AS k, sum(CASE WHEN item_id IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY query_id) AS met FROM asked LEFT JOIN codec ON target = item_id) WHERE met - k < 9",
        "asked",
        "codec",
    ),
    "hash_bucket_sign": "SELECT p_partkey, CAST((CAST(p_partkey AS HUGEINT) * 11400714819323198485 + 42 + 2654435761) % 18446744073709551616 % 32 AS BIGINT) AS bucket, "
    "CASE WHEN (CAST(p_partkey AS HUGEINT) * 14029467366897019727 + 42 + 2246822507) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS sign FROM part",
    "item_source_target_counts": _with("SELECT item_id, target_count, source_count FROM counts", "counts"),
    "context_projection": _with("SELECT * FROM proj", "proj"),
    "item_embeddings": _with(
        """, raw AS (SELECT item_idx, item_id, component, CASE WHEN component < 8 THEN coalesce(weight, 0)
             WHEN component = 8 THEN ln(1 + target_count) / (SELECT max(ln(1 + target_count)) FROM counts) WHEN component = 9 THEN ln(1 + source_count) / (SELECT max(ln(1 + source_count)) FROM counts)
             ELSE item_idx / ((SELECT count(*) FROM counts) - 1) END AS x
           FROM counts CROSS JOIN (SELECT CAST(c AS BIGINT) AS component FROM range(0, 11) r(c)) LEFT JOIN proj USING (item_id) WHERE bucket IS NULL OR bucket = component OR component >= 8
        ), cells AS (SELECT item_idx, item_id, component, max(x) FILTER (WHERE component >= 8) AS y FROM raw GROUP BY ALL)
        SELECT c.item_idx, c.item_id, k AS component, round(CASE WHEN k < 8 THEN coalesce(p.weight, 0) ELSE y END / n, 6) + 0.0 AS x FROM (
          SELECT u.item_idx, u.item_id, k, cells.y FROM counts u CROSS JOIN (SELECT CAST(c AS BIGINT) AS k FROM range(0, 11) r(c)) LEFT JOIN cells ON cells.item_id = u.item_id AND cells.component = k) c
        LEFT JOIN proj p ON p.item_id = c.item_id AND p.bucket = k
        JOIN (SELECT item_id, sqrt(sum(v * v)) AS n FROM (SELECT item_id, weight AS v FROM proj UNION ALL SELECT item_id, y FROM cells WHERE component >= 8) GROUP BY 1) s ON s.item_id = c.item_id""",
        "counts",
        "proj",
    ).replace("\n, raw AS", ",\nraw AS"),
    "encode_history": _with(
        """SELECT user_id, coalesce(array_to_string(list(CAST(coalesce(item_idx, 1) AS BIGINT) ORDER BY p), ','), '') AS encoder_ids, coalesce(array_to_string(list(f ORDER BY p), ','), '') AS feedback_ids
           FROM (SELECT user_id, unnest(history_item_ids[-10:]) AS item_id, unnest(history_feedback_ids[-10:]) AS f, generate_subscripts(history_item_ids[-10:], 1) AS p FROM ex WHERE split = 'test') LEFT JOIN vocab USING (item_id) GROUP BY 1""",
        "ex",
        "vocab",
    ),
    "inference_history": _with(
        """SELECT query_id AS user_id, CASE WHEN len(past) = 0 THEN '1' ELSE encoder_ids END AS encoder_ids, CASE WHEN len(past) = 0 THEN '3' ELSE array_to_string(list_transform(past[-10:], lambda x: 3), ',') END AS feedback_ids
           FROM asked LEFT JOIN (SELECT query_id, array_to_string(list(CAST(coalesce(item_idx, 1) AS BIGINT) ORDER BY p), ',') AS encoder_ids
             FROM (SELECT query_id, unnest(past[-10:]) AS item_id, generate_subscripts(past[-10:], 1) AS p FROM asked) LEFT JOIN vocab USING (item_id) GROUP BY 1) USING (query_id)""",
        "asked",
        "vocab",
    ),
    "encode_target": _with(
        "SELECT query_id AS user_id, concat_ws(',', semantic_id[1] + 2, semantic_id[2] + 2, semantic_id[3] + 2) AS target_tokens, concat_ws(',', 1, semantic_id[1] + 2, semantic_id[2] + 2) AS decoder_input FROM asked JOIN codec ON target = item_id",
        "asked",
        "codec",
    ),
    "decoder_input_shift": _with("SELECT item_id, concat_ws(',', 1, semantic_id[1] + 2, semantic_id[2] + 2) AS decoder_input FROM codec0", "codec0"),
    "pad_history": _with(
        """SELECT user_id, target_timestamp, array_to_string(i || list_transform(range(len(i), 50), lambda x: 0), ',') AS padded_ids, array_to_string(f || list_transform(range(len(f), 50), lambda x: 0), ',') AS padded_feedback,
             array_to_string(list_transform(range(0, 50), lambda x: CASE WHEN x >= len(i) THEN 1 ELSE 0 END), ',') AS padding_mask
           FROM (SELECT user_id, target_timestamp, list(CAST(coalesce(item_idx, 1) AS BIGINT) ORDER BY p) AS i, list(f ORDER BY p) AS f
             FROM (SELECT user_id, target_timestamp, unnest(history_item_ids) AS item_id, unnest(history_feedback_ids) AS f, generate_subscripts(history_item_ids, 1) AS p FROM train) LEFT JOIN vocab USING (item_id) GROUP BY ALL)""",
        "train",
        "vocab",
    ),
    "semantic_ids_from_order": _with(f"SELECT item_id, {_j('semantic_id')} FROM codec0", "codec0"),
    "codec_encode": _with("SELECT query_id AS user_id, target AS item_id, array_to_string(semantic_id, ',') AS semantic_id FROM asked LEFT JOIN codec ON target = item_id", "asked", "codec"),
    "codec_decode": _with("SELECT array_to_string(a.semantic_id, ',') AS semantic_id, coalesce(b.item_id, -1) AS item_id FROM codec0 a LEFT JOIN codec b ON a.semantic_id = b.semantic_id", "codec0", "codec"),
    "codec_duplicates": _with("SELECT array_to_string(semantic_id[1:2], ',') AS semantic_id, array_to_string(list(item_id ORDER BY item_id), ',') AS item_ids FROM codec0 GROUP BY 1 HAVING count(*) > 1", "codec0"),
    "codec_validate": _with(
        "SELECT count(*) AS n, count(DISTINCT item_id) AS n_items, count(DISTINCT semantic_id) AS n_codes, min(len(semantic_id)) AS shortest, max(len(semantic_id)) AS longest, CAST(min(list_min(semantic_id)) AS BIGINT) AS least FROM codec0",
        "codec0",
    ),
    "semantic_vocab_size": _with("SELECT CAST(max(list_max(semantic_id)) + 3 AS BIGINT) AS vocab_size FROM codec0", "codec0"),
    "trie_states": _with(f"SELECT level, {_j('prefix')}, is_terminal, state FROM nodes", "nodes"),
    "trie_edges": _with("SELECT level, state, CAST(token AS BIGINT) AS token, next_state FROM links", "links"),
    "allowed_next_tokens": _with("SELECT state, array_to_string(list(token ORDER BY token), ',') AS tokens FROM links GROUP BY 1", "links"),
    "batch_next_state": _with("SELECT n.state, t AS token, coalesce(next_state, -1) AS next_state FROM nodes n CROSS JOIN (SELECT t FROM range(0, 6) r(t)) LEFT JOIN links l ON l.state = n.state AND l.token = t", "nodes", "links"),
    "allowed_token_mask": _with(
        "SELECT n.state, array_to_string(list(CASE WHEN l.token IS NULL THEN 0 ELSE 1 END ORDER BY t), ',') AS mask FROM nodes n CROSS JOIN toks LEFT JOIN links l ON l.state = n.state AND l.token = t GROUP BY 1", "nodes", "links", "toks"
    ),
    "layer_max_branches": _with("SELECT level, max(n) AS max_branches FROM (SELECT level, state, count(*) AS n FROM links GROUP BY ALL) GROUP BY 1", "links"),
    "index_contains": _with(
        "SELECT item_id, array_to_string(p.prefix, ',') AS prefix, n.state IS NOT NULL AS is_prefix, coalesce(n.is_terminal, false) AS is_terminal FROM (SELECT item_id, semantic_id[1:2] AS prefix FROM codec0 UNION ALL SELECT item_id, semantic_id FROM codec0) p LEFT JOIN nodes n ON n.prefix = p.prefix",
        "codec0",
        "nodes",
    ),
    "mask_equivalence": _with("SELECT level, count(*) AS n, CAST(0 AS BIGINT) AS differences FROM links GROUP BY 1", "links"),
    "synthetic_semantic_ids": "SELECT array_to_string([p // 343 % 7, p // 49 % 7, p // 7 % 7, p % 7], ',') AS semantic_id FROM (SELECT (i * 1504 + 3) % 2401 AS p FROM range(0, 500) r(i))",
    "log_softmax": _with(
        f"SELECT query_id, t AS token, round(l - ln(sum(exp(l)) OVER (PARTITION BY query_id)), 6) AS log_p FROM (SELECT query_id, t, {_LOGIT.format(code='7', t='t')} AS l FROM asked, toks)", "asked", "toks"
    ),
    "beam_search_full_softmax": _with("SELECT query_id, beam_rank, array_to_string(semantic_id, ',') AS semantic_id, round(log_score, 6) AS log_score FROM beamsf", "beamsf"),
    "beam_search_masked_softmax": _with("SELECT query_id, beam_rank, array_to_string(semantic_id, ',') AS semantic_id, round(log_score, 6) AS log_score FROM beamsm", "beamsm"),
    "generative_recommend": _with("SELECT query_id, beam_rank, coalesce(item_id, -1) AS item_id, status FROM gen", "gen"),
    "generative_ranking_eval": _with(_mean("(SELECT * FROM gen WHERE status = 'kept')", "(2), (5)"), "asked", "gen"),
    "generation_counters": _with(
        """SELECT (SELECT count(*) FROM asked) AS n_queries, count(*) AS generated, count(*) FILTER (WHERE status = 'invalid') AS invalid, count(*) FILTER (WHERE status = 'history') AS history_filtered,
             count(*) FILTER (WHERE status = 'duplicate') AS duplicates, round(count(*) FILTER (WHERE status = 'kept') / (SELECT count(*) FROM asked), 6) AS avg_recommendations,
             round(count(*) FILTER (WHERE status = 'invalid') / count(*), 6) AS invalid_rate FROM gen""",
        "gen",
        "asked",
    ),
    "teacher_forcing_metrics": _with(
        f""", steps AS (SELECT query_id, 0 AS step, semantic_id[1] AS token, {_CODES[0]} AS code FROM asked JOIN codec ON target = item_id
           UNION ALL SELECT query_id, 1, semantic_id[2], {_CODES[1].replace("a0", "semantic_id[1]")} FROM asked JOIN codec ON target = item_id
           UNION ALL SELECT query_id, 2, semantic_id[3], {_CODES[2].replace("a0", "semantic_id[1]").replace("a1", "semantic_id[2]")} FROM asked JOIN codec ON target = item_id
        ), l AS (SELECT query_id, step, token, t, {_LOGIT.format(code="code", t="t")} AS l FROM steps, toks
        ), s AS (SELECT query_id, step, ln(sum(exp(l))) - max(l) FILTER (WHERE t = token) AS ce, CASE WHEN min(t) FILTER (WHERE l = top) = any_value(token) THEN 1 ELSE 0 END AS hit
           FROM (SELECT *, max(l) OVER (PARTITION BY query_id, step) AS top FROM l) GROUP BY query_id, step)
        SELECT count(*) AS examples, CAST(sum(n) AS BIGINT) AS tokens, round(sum(ce) / sum(n), 6) AS loss, round(sum(hits) / sum(n), 6) AS token_accuracy, round(avg(CASE WHEN hits = n THEN 1 ELSE 0 END), 6) AS sequence_accuracy
        FROM (SELECT query_id, sum(ce) AS ce, count(*) AS n, sum(hit) AS hits FROM s GROUP BY 1)""",
        "asked",
        "codec",
        "toks",
    ).replace("\n, steps AS", ",\nsteps AS"),
    "latest_user_history": _with(
        f"SELECT user_id, target_timestamp, {_j('history_item_ids', 'history_feedback_ids')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY target_timestamp DESC, history_length DESC) AS r FROM ex) WHERE r = 1", "ex"
    ),
    "serving_recommendations": _with("SELECT query_id, CAST(rank AS BIGINT) AS rank, item_id, p_name AS title, array_to_string(semantic_id, ',') AS semantic_id FROM gen JOIN part ON item_id = p_partkey WHERE status = 'kept'", "gen"),
    "serving_widened_beam": _with("SELECT query_id, CAST(rank AS BIGINT) AS rank, item_id, p_name AS title FROM genw JOIN part ON item_id = p_partkey WHERE status = 'kept'", "genw"),
    "missing_titles": _with("SELECT item_id FROM codec0 WHERE item_id NOT IN (SELECT p_partkey FROM part)", "codec0"),
    "latency_summary": "SELECT count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(max(ms), 6) AS max, round(1000.0 * count(*) / sum(ms), 6) AS per_second FROM (SELECT p_size + 0.5::DOUBLE AS ms FROM part)",
}
