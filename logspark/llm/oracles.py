"""DuckDB SQL for the queries that SQL expresses, written without the operators' code."""

from __future__ import annotations

# fixed values: word patterns and case folding of the contracts
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLDED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
PLAIN = r"'[^\x20\x09-\x0D]+'"

LICENSES = f"""
WITH phrases(words, label) AS (VALUES
    (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'),
    (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
notices(notice, label) AS (VALUES
    ('licensed under the apache license version 2 0', 'apache'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation', 'gpl'),
    ('this work is licensed under the gnu general public license version 3', 'gpl'),
    ('this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation', 'lgpl'),
    ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files', 'mit'),
    ('released under the mit license', 'mit'),
    ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd'),
    ('this source code form is subject to the terms of the mozilla public license', 'mpl'),
    ('this is free and unencumbered software released into the public domain', 'unlicense'),
    ('this work is licensed under a creative commons attribution 4 0 international license', 'cc-by'),
    ('licensed under cc by nc 4 0', 'cc-by-nc'),
    ('licensed under cc by sa 4 0', 'cc-by-sa'),
    ('all rights reserved', 'all-rights-reserved')),
templates AS (SELECT list_distinct(string_split(notice, ' ')) AS words, label FROM notices),
texts AS (SELECT doc_id, {LOWERED} AS t, regexp_extract_all({LOWERED}, {FOLDED}) AS w FROM documents),
places AS (SELECT doc_id, label, w, words, unnest(range(0, len(w) - len(words) + 1)) AS s FROM texts, phrases
           WHERE len(w) >= len(words)),
base AS (SELECT doc_id, label, s FROM places WHERE w[s + 1:s + len(words)] = words),
base_rows AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {FOLDED})) AS block FROM texts),
met AS (SELECT doc_id, label, len(list_intersect(block, words))::DOUBLE / len(words) AS share FROM lines, templates
        WHERE len(list_intersect(block, words)) >= ceil(0.8 * len(words))),
all_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
               (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM base) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM texts LEFT JOIN base_rows USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""

EXACT = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY {LOWERED}) AS keep_id,
       count(*) OVER (PARTITION BY {LOWERED}) AS group_size,
       row_number() OVER (PARTITION BY {LOWERED} ORDER BY doc_id DESC) = 1 AS kept, sha256({LOWERED}) AS text_sha256
FROM documents
"""

MIX = f"""
WITH sizes AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {PLAIN}))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
            sum(source_size) OVER () AS total FROM per),
shares AS (
    SELECT *, total - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
rate AS (SELECT rest, weights FROM shares WHERE 3 * source_size * weights > weight * rest
         ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
    SELECT source, source_size, total, (CASE WHEN 3 * s.source_size * s.weights <= s.weight * s.rest
        THEN 3 * s.source_size ELSE (s.weight * r.rest)::DOUBLE / r.weights END)::DOUBLE AS target
    FROM shares s LEFT JOIN rate r ON true),
placed AS (
    SELECT s.*, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
           / 4503599627370496::DOUBLE AS place FROM sizes s),
queued AS (
    SELECT p.*, source_size, target, total,
           sum(size) OVER (PARTITION BY p.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
items AS (
    SELECT doc_id, source, place, size, total, nr, (nr * source_size + upto)::DOUBLE / target AS finish
    FROM queued, (VALUES (0), (1), (2)) passes(nr) WHERE size > 0),
taken AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, nr, place, doc_id ROWS UNBOUNDED PRECEDING) AS spent
    FROM items),
per_doc AS (SELECT doc_id, sum(size) AS taken FROM taken WHERE spent <= total GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN per_doc USING (doc_id)
"""

LEAKS = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all({LOWERED}, {FOLDED}) AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size,
           array_to_string(w[s + 1:s + 10], ' ') AS words
    FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, regexp_extract_all({LOWERED}, {FOLDED}) AS w FROM documents),
doc_windows AS (
    SELECT doc_id, size, s, array_to_string(w[s + 1:s + size], ' ') AS words FROM (
        SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s
        FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, s, d.size FROM doc_windows d JOIN item_windows i USING (size, words)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit
              FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

CHAT = r"""
WITH RECURSIVE messages AS (
    SELECT conv_id, turn, role, text, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS raw
    FROM conversations),
lines AS (
    SELECT conv_id, turn, i, raw[i] AS line, regexp_extract(raw[i], '^((?:[ \t]*>)+)', 1) AS marks
    FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM messages)),
levels AS (
    SELECT conv_id, turn, i, len(marks) - len(replace(marks, '>', '')) AS level, substr(line, len(marks) + 1) AS body FROM lines),
flagged AS (
    SELECT *, lead(level) OVER m AS next_level, lag(level) OVER m AS last_level FROM levels
    WINDOW m AS (PARTITION BY conv_id, turn ORDER BY i)),
own AS (
    SELECT * FROM flagged WHERE level = 0 AND NOT (coalesce(next_level, 0) > 0 AND regexp_matches(body,
    '(?i)^\s*(on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió)\s*:\s*$'))),
bodies AS (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY i) AS body FROM own GROUP BY conv_id, turn),
runs AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM last_level THEN 1 ELSE 0 END) OVER
         (PARTITION BY conv_id, turn ORDER BY i) AS run FROM flagged),
quoted AS (
    SELECT DISTINCT conv_id, turn, level, unit FROM (
        SELECT conv_id, turn, level, string_agg(body, chr(10) ORDER BY i) AS unit FROM runs WHERE level > 0
        GROUP BY conv_id, turn, level, run
        UNION ALL SELECT conv_id, turn, level, body FROM runs WHERE level > 0)),
quotes AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM quoted
           WHERE trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) <> ''),
own_units AS (
    SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS unit FROM (
        SELECT conv_id, turn, body AS unit FROM bodies
        UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n\s*\n')) FROM bodies
        UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM bodies)),
links AS (
    SELECT q.conv_id, q.turn, q.level, q.unit, max(o.turn) AS source FROM quotes q JOIN own_units o
    ON q.conv_id = o.conv_id AND q.unit = o.unit AND o.turn < q.turn GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, source, sum(len(unit)) AS votes, count(*) AS n FROM links GROUP BY ALL),
parents AS (
    SELECT conv_id, turn, first(source ORDER BY level, votes DESC, source DESC) AS parent, sum(n) AS n_linked
    FROM votes GROUP BY conv_id, turn),
chains AS (
    SELECT conv_id, turn, parent AS root FROM parents
    UNION ALL SELECT c.conv_id, c.turn, p.parent FROM chains c JOIN parents p ON c.conv_id = p.conv_id AND c.root = p.turn),
roots AS (SELECT conv_id, turn, min(root) AS root FROM chains GROUP BY conv_id, turn),
counted AS (SELECT conv_id, turn, count(*) AS n_quoted FROM quotes GROUP BY conv_id, turn),
joined AS (
    SELECT m.conv_id, m.turn, m.role, parent, coalesce(root, m.turn) AS root, n_quoted, n_linked,
           CASE WHEN contains(m.text, '>') THEN trim(coalesce(body, '')) ELSE trim(coalesce(m.text, '')) END AS text
    FROM messages m LEFT JOIN parents p ON m.conv_id = p.conv_id AND m.turn = p.turn
    LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn
    LEFT JOIN counted c ON m.conv_id = c.conv_id AND m.turn = c.turn
    LEFT JOIN bodies b ON m.conv_id = b.conv_id AND m.turn = b.turn)
SELECT conv_id, turn, role, parent AS parent_turn, root AS root_turn,
       row_number() OVER (PARTITION BY conv_id ORDER BY root, turn) - 1 AS position,
       coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, text
FROM joined
"""
