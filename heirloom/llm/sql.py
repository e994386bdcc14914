"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE
      AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, sum(weight) OVER (ORDER BY most / weight, source
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
      coalesce(sum(most) OVER (ORDER BY most / weight, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
      sum(source_size) OVER () AS total FROM w),
lv AS (SELECT max((1.5::DOUBLE * total - fixed) / free) AS level FROM o),
t AS (SELECT source, source_size, least(most, weight * level) AS target FROM w, lv),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
      FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
h AS (SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || size), 1, 15))
      ::BIGINT AS place FROM d),
k AS (SELECT source, place, sum(size) AS words FROM h GROUP BY source, place),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
m AS (SELECT c.source, c.place, r.source_size, r.target, r.whole,
      CASE WHEN before + words <= rest OR (before <= rest AND 2 * (rest - before) >= words)
      THEN 1 ELSE 0 END AS more FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT h.doc_id, h.size, m.source_size, m.target, ((m.whole + m.more) * h.size)::BIGINT AS taken
FROM h JOIN m ON h.source IS NOT DISTINCT FROM m.source AND h.place = m.place
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1}

OP7 = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
n AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(words, []) AS words FROM w),
b AS (SELECT DISTINCT item_id, regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(part) AS size, array_to_string(part, ' ') AS part FROM (
   SELECT item_id, unnest(list_transform(range(1, greatest(2, len(words) - 11)),
     lambda i: words[i:i + 12])) AS part FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT row_no, size, unnest(range(1, len(words) - size + 2)) AS pos, words
   FROM n, sizes WHERE len(words) >= size),
hit AS (SELECT d.row_no, d.pos, d.size, bw.item_id FROM dw d JOIN bw
   ON bw.size = d.size AND bw.part = array_to_string(d.words[d.pos:d.pos + d.size - 1], ' ')),
found AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (
   SELECT row_no, unnest(range(pos, pos + size)) AS place FROM hit) GROUP BY row_no),
ids AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (
   SELECT DISTINCT row_no, item_id::VARCHAR AS item_id FROM hit) GROUP BY row_no)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM n LEFT JOIN found USING (row_no) LEFT JOIN ids USING (row_no)
"""

ORACLES["op7_decontaminate"] = OP7

OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

ORACLES["op9_warc"] = OP9

OP6 = r"""
WITH known(said, name) AS (VALUES
  ('this work is licensed under the gnu general public license version 3', 'gpl3_work'),
  ('this program is free software', 'gpl_program'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'gpl3_later'),
  ('you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'gpl2_later'),
  ('this program is distributed in the hope that it will be useful but without any warranty', 'gpl_hope'),
  ('licensed under the gnu general public license version 3', 'gpl3_line'),
  ('licensed under the apache license version 2 0 the license', 'apache2_the'),
  ('licensed under the apache license version 2 0', 'apache2_line'),
  ('you may not use this file except in compliance with the license', 'apache2_comply'),
  ('unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied', 'apache2_basis'),
  ('released under the mit license', 'mit_line'),
  ('licensed under the mit license', 'mit_under'),
  ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'mit_grant'),
  ('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'mit_notice'),
  ('the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement', 'mit_as_is'),
  ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd_use'),
  ('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'bsd_source'),
  ('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'bsd_binary'),
  ('neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'bsd_name'),
  ('licensed under cc by nc 4 0', 'cc_by_nc_4'),
  ('licensed under cc by sa 4 0', 'cc_by_sa_4'),
  ('licensed under cc by 4 0', 'cc_by_4'),
  ('this work is licensed under a creative commons attribution 4 0 international license', 'cc_by_4_work'),
  ('all rights reserved license', 'reserved')),
cut AS (SELECT row_number() OVER () AS row_no, doc_id,
  string_split_regex(coalesce(text, ''), '[.!?;:]+[ \t\r\n\f]+|\n[ \t\r\n\f]*\n') AS paragraphs FROM documents),
parts AS (SELECT row_no, unnest(paragraphs) AS part, generate_subscripts(paragraphs, 1) AS pos FROM cut),
wholes AS (SELECT parts.*, name FROM parts
  LEFT JOIN known ON said = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
split AS (SELECT row_no, pos, string_split_regex(part, '[\r\n]+') AS lines FROM wholes
  WHERE name IS NULL AND regexp_matches(part, '[\r\n]')),
lines AS (SELECT row_no, pos, unnest(lines) AS part, generate_subscripts(lines, 1) AS line FROM split),
hits AS (SELECT row_no, pos, 0 AS line, name FROM wholes WHERE name IS NOT NULL
  UNION ALL SELECT row_no, pos, line, name FROM lines
  JOIN known ON said = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
best AS (SELECT row_no, string_agg(name, ',' ORDER BY pos, line) AS names,
  string_agg('<' || name || '>', '' ORDER BY pos, line) AS tags FROM hits GROUP BY row_no),
r0 AS (SELECT row_no, names, replace(tags, '<bsd_use><bsd_source><bsd_binary><bsd_name>', '<>') AS tags,
  '' || CASE WHEN contains(tags, '<bsd_use><bsd_source><bsd_binary><bsd_name>') THEN 'BSD-3-Clause,' ELSE '' END AS found FROM best),
r1 AS (SELECT row_no, names, replace(tags, '<bsd_use><bsd_source><bsd_binary>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<bsd_use><bsd_source><bsd_binary>') THEN 'BSD-2-Clause,' ELSE '' END AS found FROM r0),
r2 AS (SELECT row_no, names, replace(tags, '<mit_grant><mit_notice><mit_as_is>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<mit_grant><mit_notice><mit_as_is>') THEN 'MIT,' ELSE '' END AS found FROM r1),
r3 AS (SELECT row_no, names, replace(tags, '<mit_grant><mit_notice>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<mit_grant><mit_notice>') THEN 'MIT,' ELSE '' END AS found FROM r2),
r4 AS (SELECT row_no, names, replace(tags, '<gpl_program><gpl3_later><gpl_hope>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<gpl_program><gpl3_later><gpl_hope>') THEN 'GPL-3.0-or-later,' ELSE '' END AS found FROM r3),
r5 AS (SELECT row_no, names, replace(tags, '<gpl_program><gpl3_later>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<gpl_program><gpl3_later>') THEN 'GPL-3.0-or-later,' ELSE '' END AS found FROM r4),
r6 AS (SELECT row_no, names, replace(tags, '<gpl_program><gpl2_later>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<gpl_program><gpl2_later>') THEN 'GPL-2.0-or-later,' ELSE '' END AS found FROM r5),
r7 AS (SELECT row_no, names, replace(tags, '<apache2_the><apache2_comply><apache2_basis>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<apache2_the><apache2_comply><apache2_basis>') THEN 'Apache-2.0,' ELSE '' END AS found FROM r6),
r8 AS (SELECT row_no, names, replace(tags, '<apache2_the><apache2_comply>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<apache2_the><apache2_comply>') THEN 'Apache-2.0,' ELSE '' END AS found FROM r7),
r9 AS (SELECT row_no, names, replace(tags, '<apache2_the>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<apache2_the>') THEN 'Apache-2.0,' ELSE '' END AS found FROM r8),
r10 AS (SELECT row_no, names, replace(tags, '<apache2_line>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<apache2_line>') THEN 'Apache-2.0,' ELSE '' END AS found FROM r9),
r11 AS (SELECT row_no, names, replace(tags, '<mit_line>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<mit_line>') THEN 'MIT,' ELSE '' END AS found FROM r10),
r12 AS (SELECT row_no, names, replace(tags, '<mit_under>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<mit_under>') THEN 'MIT,' ELSE '' END AS found FROM r11),
r13 AS (SELECT row_no, names, replace(tags, '<gpl3_work>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<gpl3_work>') THEN 'GPL-3.0-only,' ELSE '' END AS found FROM r12),
r14 AS (SELECT row_no, names, replace(tags, '<gpl3_line>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<gpl3_line>') THEN 'GPL-3.0-only,' ELSE '' END AS found FROM r13),
r15 AS (SELECT row_no, names, replace(tags, '<cc_by_nc_4>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<cc_by_nc_4>') THEN 'CC-BY-NC-4.0,' ELSE '' END AS found FROM r14),
r16 AS (SELECT row_no, names, replace(tags, '<cc_by_sa_4>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<cc_by_sa_4>') THEN 'CC-BY-SA-4.0,' ELSE '' END AS found FROM r15),
r17 AS (SELECT row_no, names, replace(tags, '<cc_by_4>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<cc_by_4>') THEN 'CC-BY-4.0,' ELSE '' END AS found FROM r16),
r18 AS (SELECT row_no, names, replace(tags, '<cc_by_4_work>', '<>') AS tags,
  found || CASE WHEN contains(tags, '<cc_by_4_work>') THEN 'CC-BY-4.0,' ELSE '' END AS found FROM r17),
named AS (SELECT row_no, names, tags, list_filter(string_split(found, ','), lambda x: x <> '') AS all_found FROM r18)
SELECT doc_id, coalesce(names, '') AS sentences,
  coalesce(array_to_string(list_filter(all_found, lambda x, i: list_position(all_found, x) = i), ','), '') AS licenses,
  coalesce(replace(trim(regexp_replace(replace(tags, '<>', ''), '[<>]+', ' ', 'g')), ' ', ','), '') AS leftover
FROM cut LEFT JOIN named USING (row_no)
"""

ORACLES["op6_license_scan"] = OP6
