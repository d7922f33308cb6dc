"""The same results in plain SQL for DuckDB, built from named parts."""

from graphlib import TopologicalSorter

# name -> (parts it reads, text)
PARTS: dict[str, tuple[list[str], str]] = {
    "tf": ([], r"""
        SELECT doc_id, w, count(*) AS tf
        FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents)
        WHERE length(w) >= CASE WHEN lang = 'ko' THEN 2 ELSE 3 END GROUP BY doc_id, w"""),
    "vocab": (["tf"], """
        SELECT w, count(*) AS df, CAST(round(ln(((SELECT count(*) FROM documents) + CAST(1 AS DOUBLE))
            / (count(*) + CAST(1 AS DOUBLE))) * 1000000) AS BIGINT) AS idf
        FROM tf GROUP BY w"""),
    "weights": (["tf", "vocab"], """
        SELECT doc_id, w, CAST(tf * idf AS BIGINT) AS s FROM tf JOIN vocab USING (w)"""),
    "totals": (["weights"], """
        SELECT doc_id, CAST(sum(s) AS BIGINT) AS total FROM weights GROUP BY doc_id"""),
    "kw": (["weights"], """
        SELECT doc_id, w, s, CAST(s * 1000 // sum(s) OVER (PARTITION BY doc_id) AS BIGINT) AS pm, rk
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, w) AS rk
              FROM weights WHERE s > 0)
        WHERE rk <= 20"""),
    "pieces": ([], r"""
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, trim(unnest(l)) AS line
        FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?。！？…\n]+[.!?。！？…]?') AS l FROM documents)"""),
    "sents": (["pieces"], "SELECT doc_id, pos, line FROM pieces WHERE line <> ''"),
    "lines": (["sents"], "SELECT doc_id, min(pos) AS pos, line FROM sents GROUP BY doc_id, line"),
    "scored_lines": (["lines", "weights"], r"""
        SELECT doc_id, pos, line, count(*) AS n_words, CAST(sum(s) // count(*) AS BIGINT) AS score
        FROM (SELECT DISTINCT doc_id, pos, line, unnest(regexp_extract_all(lower(line), '\p{L}+')) AS w
              FROM lines) JOIN weights USING (doc_id, w)
        GROUP BY doc_id, pos, line"""),
    "summary": (["lines", "scored_lines"], """
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no, line
        FROM (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id
                  ORDER BY CASE WHEN n_words >= 5 THEN score END DESC NULLS LAST, pos) AS rk
              FROM lines LEFT JOIN scored_lines USING (doc_id, pos, line))
        WHERE rk <= 3"""),
    "reads": ([], """
        SELECT event_id, ts, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS doc_id
        FROM events WHERE event_type IN ('view', 'click') AND regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+$')
            AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL"""),
    "read_pairs": (["reads"], """
        SELECT user_id, doc_id, count(*) AS n FROM reads GROUP BY user_id, doc_id"""),
    "recent_read_pairs": (["reads"], """
        SELECT user_id, doc_id, CAST(sum(greatest(1, 8 - (last - day))) AS BIGINT) AS n FROM
            (SELECT user_id, doc_id, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS last
             FROM reads)
        GROUP BY user_id, doc_id"""),
    "marked": (["reads"], """
        SELECT *, CASE WHEN ts <= lag(ts) OVER u + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts,
            lag(doc_id) OVER u AS before
        FROM reads WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)"""),
    "sessions": (["marked"], """
        SELECT user_id, count(*) AS reads, CAST(sum(starts) AS BIGINT) AS sessions FROM marked GROUP BY user_id"""),
    "times": (["reads"], """
        SELECT user_id, fav_hour, fav_weekday FROM
            (SELECT user_id, h AS fav_hour, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, h) AS rk
             FROM (SELECT user_id, hour(ts) AS h, count(*) AS c FROM reads GROUP BY ALL)) a
        JOIN (SELECT user_id, d AS fav_weekday, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, d) AS rk
             FROM (SELECT user_id, isodow(ts) - 1 AS d, count(*) AS c FROM reads GROUP BY ALL)) b
        USING (user_id, rk) WHERE rk = 1"""),
    "pattern": (["reads", "sessions", "times"], """
        SELECT user_id, reads, articles, active_days, sessions, fav_hour, fav_weekday
        FROM sessions JOIN times USING (user_id) JOIN
            (SELECT user_id, count(DISTINCT doc_id) AS articles, count(DISTINCT CAST(ts AS DATE)) AS active_days
             FROM reads GROUP BY user_id) USING (user_id)"""),
    "together": (["marked", "read_pairs"], """
        WITH p AS (SELECT least(before, doc_id) AS i, greatest(before, doc_id) AS j, count(DISTINCT user_id) AS c
                   FROM marked WHERE starts = 0 AND before <> doc_id GROUP BY ALL),
             r AS (SELECT doc_id, count(*) AS n FROM read_pairs GROUP BY doc_id)
        SELECT i, j, c, c * 1000000 // (a.n + b.n - c) AS jac
        FROM p JOIN r a ON a.doc_id = i JOIN r b ON b.doc_id = j"""),
    "coread": (["read_pairs"], """
        WITH n AS (SELECT doc_id, count(*) AS n FROM read_pairs WHERE doc_id IS NOT NULL GROUP BY doc_id),
             c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM read_pairs a JOIN read_pairs b USING (user_id)
                   WHERE a.doc_id <> b.doc_id GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY jac DESC, j) AS rk FROM
            (SELECT i, j, c, c * 1000000 // (x.n + y.n - c) AS jac
             FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j)"""),
    "offered": (["coread", "read_pairs"], """
        SELECT user_id, j AS doc_id, CAST(sum(jac) AS BIGINT) AS score
        FROM read_pairs JOIN coread ON i = doc_id WHERE rk <= 10 GROUP BY user_id, j"""),
    "unread_offers": (["offered", "read_pairs"], "SELECT * FROM offered ANTI JOIN read_pairs USING (user_id, doc_id)"),
    "matched": (["scores"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rk
                       FROM scores) WHERE rk <= 20"""),
    "fresh": (["scores", "read_pairs"], """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rk
        FROM scores ANTI JOIN read_pairs USING (user_id, doc_id)"""),
    "copies": ([], "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents"),
    "grams": ([], r"""
        SELECT DISTINCT doc_id, w || ' ' || w2 || ' ' || w3 AS g FROM
            (SELECT doc_id, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM
                (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS w FROM
                    (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS l FROM documents))
             WINDOW p AS (PARTITION BY doc_id ORDER BY pos))
        WHERE w3 IS NOT NULL"""),
    "first_grams": (["grams", "copies"], """
        SELECT * FROM grams SEMI JOIN (SELECT doc_id FROM copies WHERE doc_id = first_id) USING (doc_id)"""),
    "near": (["first_grams"], """
        WITH n AS (SELECT doc_id, count(*) AS n FROM first_grams GROUP BY doc_id),
             o AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM first_grams a JOIN first_grams b
                   ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT i, j FROM o JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 2 * o >= a.n + b.n - o"""),
    "both_ways": (["near"], "SELECT i, j FROM near UNION ALL SELECT j, i FROM near"),
    "set_classes": (["first_grams"], """
        SELECT first_id, min(first_id) OVER (PARTITION BY gs) AS class_id FROM
            (SELECT doc_id AS first_id, string_agg(g, '|' ORDER BY g) AS gs FROM first_grams GROUP BY doc_id)"""),
    "class_members": (["copies", "set_classes"], """
        SELECT doc_id, first_id, coalesce(class_id, first_id) AS class_id FROM copies LEFT JOIN set_classes USING (first_id)"""),
    "link_counts": (["both_ways", "class_members"], """
        SELECT i AS first_id, count(*) AS n_links FROM both_ways JOIN class_members a ON a.doc_id = i
        JOIN class_members b ON b.first_id = j WHERE a.class_id <> b.class_id GROUP BY i"""),
    "linked": (["class_members", "link_counts"], """
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links
        FROM class_members LEFT JOIN link_counts USING (first_id)"""),
    "reach": (["both_ways", "copies"], """
        SELECT first_id AS a, first_id AS b FROM copies
        UNION SELECT reach.a, both_ways.j FROM reach JOIN both_ways ON reach.b = both_ways.i"""),
    "grouped": (["reach", "copies"], """
        SELECT doc_id, group_id FROM copies JOIN
            (SELECT a AS first_id, min(b) AS group_id FROM reach GROUP BY a) USING (first_id)"""),
    "cards": (["kw"], "SELECT doc_id, lang, w, pm FROM kw JOIN documents USING (doc_id) WHERE pm > 0"),
    "cw0": (["cards", "totals", "copies"], """
        SELECT lang, topic, w, pm AS cw FROM cards JOIN
            (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY total DESC, doc_id) AS topic
             FROM documents SEMI JOIN (SELECT doc_id FROM copies WHERE doc_id = first_id) USING (doc_id)
             JOIN totals USING (doc_id)) USING (doc_id)
        WHERE topic <= 5"""),
}
for _p in ("", "recent_"):  # every read counted once, and those of recent days more often
    PARTS[f"{_p}interest"] = ([f"{_p}read_pairs", "kw"], f"""
        SELECT * FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iw DESC, w) AS rk FROM
                (SELECT user_id, w, CAST(sum(n * pm) AS BIGINT) AS iw
                 FROM {_p}read_pairs JOIN kw USING (doc_id) WHERE pm > 0 GROUP BY user_id, w))
        WHERE rk <= 50""")
    PARTS[f"{_p}scores"] = ([f"{_p}interest", "kw"], f"""
        SELECT user_id, doc_id, CAST(sum(iw * pm) AS BIGINT) AS score
        FROM {_p}interest JOIN kw USING (w) WHERE pm > 0 GROUP BY user_id, doc_id""")
for _r in range(3):
    PARTS[f"in{_r}"] = (["cards", f"cw{_r}"], f"""
        SELECT doc_id, lang, topic FROM
            (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rk FROM
                (SELECT doc_id, lang, topic, sum(pm * cw) AS score FROM cards JOIN cw{_r} USING (lang, w)
                 GROUP BY ALL) WHERE score > 0)
        WHERE rk = 1""")
    PARTS[f"cw{_r + 1}"] = (["cards", f"in{_r}"], f"""
        SELECT lang, topic, w, iw * 1000 // sum(iw) OVER (PARTITION BY lang, topic) AS cw FROM
            (SELECT *, row_number() OVER (PARTITION BY lang, topic ORDER BY iw DESC, w) AS rk FROM
                (SELECT lang, topic, w, sum(pm) AS iw FROM cards JOIN in{_r} USING (doc_id, lang) GROUP BY ALL))
        WHERE rk <= 50""")
PARTS |= {
    "topics": (["in2"], """
        SELECT doc_id, d.lang, coalesce(topic, 0) AS topic FROM documents d LEFT JOIN in2 USING (doc_id)"""),
    "labels": (["topics"], "SELECT doc_id, topics.lang, topic, source FROM topics JOIN documents USING (doc_id)"),
    "label_words": (["cards", "topics"], """
        SELECT lang, topic, w, iw FROM
            (SELECT *, row_number() OVER (PARTITION BY lang, topic ORDER BY iw DESC, w) AS rk FROM
                (SELECT lang, topic, w, sum(pm) AS iw FROM cards JOIN topics USING (doc_id, lang)
                 WHERE topic > 0 GROUP BY ALL))
        WHERE rk <= 5"""),
    "pool": (["fresh", "labels"], "SELECT user_id, doc_id, score, lang, topic, source FROM fresh JOIN labels USING (doc_id)"),
    "offers": (["recent_scores", "grouped", "read_pairs", "labels"], """
        SELECT user_id, doc_id, score, lang, topic, source FROM recent_scores
        SEMI JOIN (SELECT doc_id FROM grouped WHERE doc_id = group_id) USING (doc_id)
        ANTI JOIN (SELECT user_id, group_id AS doc_id FROM read_pairs JOIN grouped USING (doc_id)) USING (user_id, doc_id)
        JOIN labels USING (doc_id)"""),
    "texts": (["kw", "summary"], """
        SELECT doc_id, keywords, summary FROM documents
        LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY rk) AS keywords FROM kw WHERE rk <= 5 GROUP BY doc_id)
            USING (doc_id)
        LEFT JOIN (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS summary FROM summary GROUP BY doc_id)
            USING (doc_id)"""),
}


def _drawn(turn: int) -> str:
    return f"('0x' || substr(md5('7:{turn}:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double"


def _nearest(centres: str) -> str:
    return f"""
        SELECT doc_id, topic, sim FROM
            (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) AS rk FROM
                (SELECT doc_id, topic, sum(v * u)::bigint AS sim FROM unit JOIN {centres} USING (w) GROUP BY ALL))
        WHERE rk = 1"""


PARTS |= {
    "unit": (["kw"], """
        SELECT * FROM (SELECT doc_id, w, floor(1000.0::double * pm / sqrt((sum(pm * pm) OVER (PARTITION BY doc_id))::double))::bigint AS v
                       FROM kw WHERE pm > 0) WHERE v > 0"""),
    "able": (["unit", "copies"], """
        SELECT DISTINCT doc_id FROM unit SEMI JOIN (SELECT doc_id FROM copies WHERE doc_id = first_id) USING (doc_id)"""),
    "drawn0": (["able"], f"SELECT doc_id FROM able ORDER BY {_drawn(0)}, doc_id LIMIT 1"),
}
for _r in (1, 2):
    PARTS[f"known{_r}"] = ([f"drawn{_r - 1}", "unit"], f"""
        SELECT doc_id AS topic, w, v AS u FROM unit SEMI JOIN drawn{_r - 1} USING (doc_id)""")
    PARTS[f"away{_r}"] = (["able", "unit", f"known{_r}"], f"""
        SELECT doc_id, greatest(0, 1000000 - coalesce(sim, 0))::double AS d FROM able LEFT JOIN ({_nearest(f"known{_r}")}) USING (doc_id)""")
    PARTS[f"drawn{_r}"] = ([f"drawn{_r - 1}", f"away{_r}"], f"""
        SELECT doc_id FROM drawn{_r - 1} UNION SELECT doc_id FROM away{_r}
        WHERE d > 0 AND {_drawn(_r)} * (SELECT sum(d) FROM away{_r}) < 40.0::double * d""")
PARTS |= {
    "known3": (["drawn2", "unit"], "SELECT doc_id AS topic, w, v AS u FROM unit SEMI JOIN drawn2 USING (doc_id)"),
    "centres0": (["known3", "able", "unit"], f"""
        SELECT t.topic, w, v AS u FROM unit JOIN
            (SELECT topic AS doc_id, row_number() OVER (ORDER BY count(*) DESC, topic) AS topic
             FROM ({_nearest("known3")}) SEMI JOIN able USING (doc_id) GROUP BY topic) t USING (doc_id)
        WHERE t.topic <= 20"""),
    "near2": (["unit", "centres2"], _nearest("centres2")),
    "clustered": (["near2"], "SELECT doc_id, coalesce(topic, 0) AS topic FROM documents LEFT JOIN near2 USING (doc_id)"),
}
for _r in (0, 1):
    PARTS[f"near{_r}"] = (["unit", f"centres{_r}"], _nearest(f"centres{_r}"))
    PARTS[f"centres{_r + 1}"] = (["unit", f"near{_r}"], f"""
        SELECT topic, w, floor(1000000.0::double * c / sqrt((sum(c * c) OVER (PARTITION BY topic))::double))::bigint AS u FROM
            (SELECT topic, w, (sum(v) * 1000 // any_value(members))::bigint AS c
             FROM unit JOIN near{_r} USING (doc_id) JOIN (SELECT topic, count(*) AS members FROM near{_r} GROUP BY topic) USING (topic)
             GROUP BY topic, w)
        WHERE c > 0
        QUALIFY u > 0""")
PARTS["picked0"] = ([], """
    SELECT NULL::VARCHAR AS lang, NULL::BIGINT AS topic, NULL::VARCHAR AS source, NULL::BIGINT AS doc_id,
        NULL::BIGINT AS score, NULL::BIGINT AS rk WHERE false""")
for _r in range(1, 11):  # per topic and round, what adds most to what was picked before
    PARTS[f"picked{_r}"] = ([f"picked{_r - 1}", "labels", "kw"], f"""
        WITH last AS (SELECT lang, topic, source, doc_id, score, {_r} AS rk FROM
                (SELECT l.lang, l.topic, l.source, doc_id, sum(pm)::bigint AS score,
                    row_number() OVER (PARTITION BY l.lang, l.topic ORDER BY sum(pm) DESC, doc_id) AS best
                 FROM labels l JOIN kw USING (doc_id)
                 WHERE l.topic > 0 AND pm > 0
                    AND NOT EXISTS (SELECT 1 FROM picked{_r - 1} p JOIN kw k ON k.doc_id = p.doc_id AND k.pm > 0
                        WHERE p.lang IS NOT DISTINCT FROM l.lang AND p.topic = l.topic AND k.w = kw.w)
                    AND NOT EXISTS (SELECT 1 FROM picked{_r - 1} p WHERE p.lang IS NOT DISTINCT FROM l.lang
                        AND p.topic = l.topic AND p.source IS NOT DISTINCT FROM l.source)
                 GROUP BY l.lang, l.topic, l.source, doc_id)
             WHERE best = 1)
        SELECT * FROM picked{_r - 1} UNION ALL SELECT * FROM last""")
for _name, _from in (("limited", "pool"), ("feed", "offers")):
    PARTS[_name] = ([_from], f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, doc_id) AS rank FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id, lang, topic ORDER BY score DESC, doc_id) AS t FROM
                (SELECT *, row_number() OVER (PARTITION BY user_id, lang, topic, source
                                              ORDER BY score DESC, doc_id) AS o FROM {_from}) WHERE o = 1)
            WHERE t <= 2) WHERE rank <= 10""")


def _big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


# name of the query -> (part, selected columns, condition)
RESULTS = {
    "word_counts": ("tf", f"doc_id, w, {_big('tf')}", ""),
    "sentences": ("sents", f"doc_id, {_big('pos')}, line", ""),
    "word_weights": ("weights", "doc_id, w, s", ""),
    "keyword_extract": ("kw", f"doc_id, w, s, pm, {_big('rk')}", "WHERE rk <= 5"),
    "sentence_scores": ("scored_lines", f"doc_id, {_big('pos')}, line, {_big('n_words', 'score')}", ""),
    "three_line_summary": ("summary", f"doc_id, {_big('line_no')}, line", ""),
    "read_log": ("reads", "event_id, ts, user_id, doc_id", ""),
    "read_sessions": ("sessions", f"user_id, {_big('reads', 'sessions')}", ""),
    "reading_times": ("times", f"user_id, {_big('fav_hour', 'fav_weekday')}", ""),
    "reading_pattern": (
        "pattern",
        f"user_id, {_big('reads', 'articles', 'active_days', 'sessions', 'fav_hour', 'fav_weekday')}",
        "",
    ),
    "next_read": ("together", _big("i", "j", "c", "jac"), ""),
    "read_together": ("coread", _big("i", "j", "c", "jac", "rk"), "WHERE rk <= 10"),
    "interest_profile": ("interest", f"user_id, w, {_big('iw', 'rk')}", ""),
    "interest_match": ("matched", f"user_id, doc_id, {_big('score', 'rk')}", ""),
    "unread": ("unread_offers", "user_id, doc_id, score", ""),
    "recommend": ("fresh", f"user_id, doc_id, {_big('score', 'rk')}", "WHERE rk <= 10"),
    "shingles": ("grams", "doc_id, g", ""),
    "near_links": ("linked", f"doc_id, class_id, {_big('class_size', 'n_links')}", ""),
    "duplicate_groups": ("grouped", "doc_id, group_id", ""),
    "remove_duplicates": (
        "documents JOIN (SELECT group_id, count(*) AS group_size FROM grouped GROUP BY group_id)"
        " ON doc_id = group_id",
        f"doc_id, text, lang, source, n_chars, group_id, {_big('group_size')}",
        "",
    ),
    "topic_rounds": ("in2", f"doc_id, lang, {_big('topic')}", ""),
    "topic_group": ("topics", f"doc_id, lang, {_big('topic')}", ""),
    "kmeans_topics": ("clustered", f"doc_id, {_big('topic')}", ""),
    "topic_labels": ("label_words", f"lang, {_big('topic')}, w, {_big('iw')}", ""),
    "perspectives": (
        "picked10", f"lang, {_big('topic')}, source, doc_id, {_big('score', 'rk')}", ""
    ),
    "limit_feed": (
        "limited", f"user_id, doc_id, score, lang, {_big('topic')}, source, {_big('rank')}", ""
    ),
    "curated_feed": (
        "feed JOIN texts USING (doc_id)",
        f"user_id, {_big('rank')}, doc_id, lang, {_big('topic')}, source, score, keywords, summary",
        "",
    ),
}


def _needed(source: str) -> list[str]:
    todo = [p for p in PARTS if p in source.replace("(", " ").replace(")", " ").split()]
    graph: dict[str, list[str]] = {}
    while todo:
        part = todo.pop()
        if part not in graph:
            graph[part] = PARTS[part][0]
            todo += PARTS[part][0]
    return list(TopologicalSorter(graph).static_order())


def oracle_sql() -> dict[str, str]:
    """The SQL text of every query that SQL can express."""
    texts = {}
    for name, (source, columns, where) in RESULTS.items():
        parts = _needed(source)
        stored = ", ".join(
            f"{p} AS {'' if p == 'reach' else 'MATERIALIZED '}({PARTS[p][1]})" for p in parts
        )
        recursive = "RECURSIVE " if "reach" in parts else ""
        texts[name] = f"WITH {recursive}{stored} SELECT {columns} FROM {source} {where}"
    return texts
