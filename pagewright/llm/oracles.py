"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from pagewright.llm import chats, licences, urls

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"

#: A text's 5-word shingles, or the whole sequence if it is shorter.
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

CONTAMINATED = f"""
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM (
    SELECT d.doc_id, i.item_id, i.n AS item_shingles, count(*) AS shared
    FROM (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)) d
    JOIN (SELECT item_id, len(l) AS n, unnest(l) AS s FROM (SELECT item_id, {_SHINGLES} AS l FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark))) i USING (s)
    GROUP BY ALL)
WHERE shared / item_shingles >= 0.8 - 1e-9
"""


def licence_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licences.SENTENCES.items())
    steps, at = "", "l0"
    for k, r in enumerate(licences.RULES):
        spelled = "," + ",,".join(r.sequence) + ","
        steps += f", s{k + 1} AS (SELECT *, replace({at}, '{spelled}', ',|,') AS l{k + 1}, contains({at}, '{spelled}') AS m{k + 1} FROM s{k})"
        at = f"l{k + 1}"
    seen: dict[str, list[str]] = {}
    for k, r in enumerate(licences.RULES):
        seen.setdefault(r.licence, []).append(f"m{k + 1}")
    firsts = []
    for licence, marks in seen.items():  # a licence stands where its first matching rule stands
        order = "CASE " + " ".join(f"WHEN {m} THEN {int(m[1:])}" for m in marks) + " END"
        firsts.append(f"{{'o': {order}, 'l': '{licence}'}}")
    end = licences.SENTENCE_END.replace("'", "''")
    body = f"regexp_replace(coalesce(text, ''), '{licences.ABBREVIATED}', 'v \\1', 'g')"
    sentence = "trim(regexp_replace(lower(@), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, instead in licences.FIELDS:
        sentence = f"regexp_replace({sentence}, '{pattern}', '{instead.replace('$', chr(92))}', 'g')"
    heads = "|".join(licences.openings())
    return f"""
WITH known(s, i) AS (VALUES {known}),
pieces AS (
    SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS k
    FROM (SELECT doc_id, regexp_split_to_array({body}, '{end}') AS l FROM documents)),
wholes AS (
    SELECT doc_id, k, unnest(l) AS s, unnest(range(len(l))) AS k2
    FROM (SELECT doc_id, k, string_split(regexp_replace({sentence.replace("@", "p")}, ' ({heads})\\b', chr(10) || '\\1', 'g'), chr(10)) AS l FROM pieces)),
own AS (SELECT doc_id, k, k2, i FROM wholes JOIN known USING (s)),
lines AS (
    SELECT doc_id, k, {sentence.replace("@", "line")} AS s, k2
    FROM (SELECT doc_id, k, unnest(l) AS line, unnest(range(len(l))) AS k2 FROM (SELECT doc_id, k, string_split(p, chr(10)) AS l FROM pieces ANTI JOIN own USING (doc_id, k)))),
hits AS (SELECT doc_id, k, k2, i FROM own UNION ALL SELECT doc_id, k, k2, i FROM lines JOIN known USING (s)),
s0 AS (
    SELECT doc_id, count(i) AS n_sentences, coalesce(string_agg(i, ',' ORDER BY k, k2), '') AS sequence, coalesce(string_agg(',' || i || ',', '' ORDER BY k, k2), '') AS l0
    FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id){steps}
SELECT doc_id, n_sentences, sequence,
    array_to_string(list_transform(list_sort(list_filter([{", ".join(firsts)}], lambda x: x.o IS NOT NULL)), lambda x: x.l), ',') AS licences,
    array_to_string(list_filter(regexp_split_to_array({at}, '[,|]+'), lambda x: x <> ''), ',') AS unmatched
FROM s{len(licences.RULES)}
"""


def crc_table() -> list[int]:
    """What four bits do to a CRC-32, by its polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: The checksum is taken four bits at a time over the text's hex digits, the low half of each byte first.
SHARDS = f"""
WITH digits AS (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
        md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
    FROM documents),
halves AS (
    SELECT text, instr('0123456789ABCDEF', unnest(string_split(hex(encode(text)), ''))) - 1 AS half, xor(unnest(range(2 * strlen(text))), 1) AS k
    FROM (SELECT DISTINCT text FROM digits) x WHERE text <> ''),
lists AS (SELECT text, list_prepend(4294967295, list(half ORDER BY k)) AS l FROM halves GROUP BY text),
sums AS (SELECT text, xor(list_reduce(l, lambda c, d: xor(c >> 4, {crc_table()}[(xor(c, d) & 15) + 1])), 4294967295) AS crc FROM lists),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM digits),
placed AS (SELECT *, row_number() OVER (ORDER BY (r - 1 + CAST('0x' || substr(md5(source), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE) / n, source, key, doc_id) - 1 AS place FROM ranked)
SELECT doc_id, CAST(strlen(text) AS BIGINT) + 16 AS size, CAST(coalesce(crc, 0) AS BIGINT) AS text_crc32, 'rows' AS law,
    CAST(place * 40 // total AS INTEGER) AS shard, place - ((place * 40 // total) * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed LEFT JOIN sums USING (text)
"""


def urls_sql() -> str:
    """With the whole closure over alias edges; components are closed by repeated steps to the smallest node."""
    value = """\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>][^\\s>]*)"""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    inner = quoted(r"""(?s)^["'](.*)["']$""")
    attr = lambda name: f"regexp_replace(regexp_extract(tag, {quoted(f'(?is)[\\s/]{name}{value}')}, 1), {inner}, '\\1')"
    hidden = quoted(r"(?is)<!--.*?(?:-->|\z)|<script\b.*?</script|<style\b.*?</style|<title\b.*?</title|<textarea\b.*?</textarea")
    whole_tag = quoted(r"""(?is)<(?:link|meta|base)[\s/](?:[^"'>]|"[^"]*"|'[^']*')*>""")
    after = quoted(r"(?is)^\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?[\"']?([^\"']*)")
    plain = lambda c: f"replace(replace(replace({c}, '&#38;', '&'), '&#x26;', '&'), '&amp;', '&')"
    when = []
    for r in sorted(urls.RULES, key=lambda r: (-len(r.name), -len(r.host))):
        when.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'")
    rule = f"CASE {' '.join(when)} END"
    parts = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"
    head = "regexp_extract({0}, '(?s)^([^#]*?://[^/?#]*)', 1)"
    node = f"translate({head}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_extract({{0}}, '(?s)^([^#]*)', 1), length({head}) + 1)"
    return f"""
WITH RECURSIVE tags AS (
    SELECT page_id, url, unnest(t) AS tag, generate_subscripts(t, 1) AS i
    FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, {hidden}, ' ', 'g'), {whole_tag}) AS t FROM pages WHERE url IS NOT NULL)),
attributes AS (SELECT page_id, url, i, lower(tag[2:5]) AS kind, lower({attr("rel")}) AS rel, {plain(attr("href"))} AS href, lower({attr("http-equiv")}) AS equiv, {plain(attr("content"))} AS content FROM tags),
bases AS (SELECT page_id, arg_min(href, i) AS base FROM attributes WHERE kind = 'base' AND href <> '' GROUP BY 1),
named AS (
    SELECT coalesce(base, url) AS base, url, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(rel, '\\s+'), 'canonical') THEN href
        WHEN kind = 'meta' AND equiv = 'refresh' THEN regexp_extract(content, {after}, 1) END AS target
    FROM attributes LEFT JOIN bases USING (page_id)),
whole AS (
    SELECT url, CASE WHEN contains(target, '://') THEN target
        WHEN starts_with(target, '//') AND contains(base, ':/') THEN regexp_extract(base, '(?s)^(.*?):/', 1) || ':' || target
        WHEN starts_with(target, '/') AND contains(base, '://') THEN regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || target END AS target FROM named WHERE target <> ''),
edges AS (SELECT {node.format("url")} AS a, {node.format("target")} AS b FROM whole WHERE target IS NOT NULL),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
nodes AS (SELECT b AS node, min(a) AS component FROM reach GROUP BY b),
judged AS (SELECT component, {rule} AS own FROM (SELECT component, {parts.format("node")} FROM nodes)),
classes AS (SELECT component, CASE WHEN bool_or(own LIKE 'allow%') THEN 'allow' WHEN bool_or(own LIKE 'block%') THEN 'block' END AS by_alias FROM judged GROUP BY 1),
rows AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path, {rule} AS own FROM (SELECT page_id, url, {parts.format("url")} FROM pages))
SELECT page_id, host, path, split_part(own, ' ', 2) AS rule, coalesce(split_part(own, ' ', 1), by_alias, 'allow') AS verdict
FROM rows LEFT JOIN nodes ON node = {node.format("url")} LEFT JOIN classes USING (component)
"""


def chats_sql() -> str:
    inner = "".join(f" + (len(t) - len(replace(t, '{c}', ''))) // {len(c)} * 2" for c in chats.CONTROLS)
    marks = len("<|turn|>") + len("<|text|>") + len("<|end|>")
    return f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, k, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(k)),
sizes AS (SELECT *, {marks} + length(r) + length(t) + (length(t) - length(replace(t, '{chats.MARK}', ''))){inner} AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
    CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""


#: A line's key by a pattern of its own; documents of a key are counted as such.
LINES = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def trie_sql() -> str:
    """Rebuilt conversations as lists of turns, and nodes as their beginnings; subtrees by comparing beginnings."""
    return f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 's': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
    SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(xor(c, b) >> 8, {byte_table()}[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM own),
built AS (
    SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS l
    FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
ways AS (SELECT conv_id, len(l) AS n, l, unnest(range(len(l) + 1)) AS depth FROM built),
nodes AS (
    SELECT CAST(depth AS BIGINT) AS depth, l[1:depth] AS way, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM ways GROUP BY depth, l[1:depth]),
below AS (
    SELECT a.conv_id, a.depth, count(*) FILTER (b.depth = a.depth + 1) AS n_children,
        sum(CASE WHEN b.depth > 0 THEN (b.n_convs - 1) * strlen(b.way[b.depth].s) ELSE 0 END) AS saved_tokens,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth = b.depth + 1 AND c.way[1:b.depth] = b.way)) AS n_leaves
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.way[1:a.depth] = a.way GROUP BY a.conv_id, a.depth)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a JOIN below USING (conv_id, depth) LEFT JOIN nodes p ON p.depth = a.depth - 1 AND a.way[1:a.depth - 1] = p.way
"""


def byte_table() -> list[int]:
    """What a byte does to a CRC-32, by its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


ORACLES = {
    "op1_decontaminate": CONTAMINATED,
    "op2_licences": licence_sql(),
    "op7_shards": SHARDS,
    "op9_urls": urls_sql(),
    "op10_chats": chats_sql(),
    "op12_lines": LINES,
    "op13_prefix_trie": trie_sql(),
}
