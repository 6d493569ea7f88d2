"""DuckDB SQL for the operators that SQL can express."""

from tablevitals.llm import divergence, embeddings, infilling, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

# All pairs of documents that share a shingle, and everything reachable over links.
NEAR_DUPLICATES = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM own WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least_id ON id = d.doc_id"""

_GAMMA = f"({1 + quality.ACCURACY}e0 / {1 - quality.ACCURACY}e0)"
_RATIOS = {rule: "{}::DOUBLE / nullif({}, 0)".format(*formula.split(" / ")) for rule, (formula, _, _) in quality.RULES.items()}


def _quality() -> str:
    tall = "\nUNION ALL ".join(f"SELECT doc_id, lang, source, '{rule}' AS rule, {ratio} AS value FROM counts" for rule, ratio in _RATIOS.items())
    spread = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {least}e0" for rule, (_, _, least) in quality.RULES.items()) + " END"
    sided = ", ".join(f"'{rule}'" for rule, (_, low, _) in quality.RULES.items() if low)
    return f"""
WITH own AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    {_WORDS.format(text="coalesce(text, '')")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM own)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper
  FROM own LEFT JOIN covered USING (doc_id)),
failed AS (SELECT doc_id, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
tall AS ({tall}),
buckets AS (
  SELECT lang, source, rule, CASE WHEN value < {quality.SMALLEST} THEN 0
    ELSE 1 + floor(ln(value / {quality.SMALLEST}) / ln({_GAMMA}))::INTEGER END AS bucket
  FROM tall JOIN failed USING (doc_id) WHERE NOT base_failed AND value IS NOT NULL),
merged AS (
  SELECT lang, source, rule, bucket, count(*) AS n, grouping(lang, source) AS level
  FROM buckets GROUP BY GROUPING SETS ((lang, source, rule, bucket), (lang, rule, bucket), (rule, bucket))),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rule) AS total,
    CASE WHEN bucket = 0 THEN 0e0 ELSE {quality.SMALLEST} * pow({_GAMMA}, bucket - 0.5e0) END AS value
  FROM merged),
quantiles AS (
  SELECT level, lang, source, rule, max(total) AS total, min(value) FILTER (upto >= 0.25e0 * total) AS q25,
    min(value) FILTER (upto >= 0.75e0 * total) AS q75 FROM ranked GROUP BY ALL),
fences AS (
  SELECT level, lang, source, rule, max(total) OVER (PARTITION BY level, lang, source) AS total,
    CASE WHEN rule IN ({sided}) THEN q25 - {quality.REACH}e0 * greatest(q75 - q25, {spread}) END AS low,
    q75 + {quality.REACH}e0 * greatest(q75 - q25, {spread}) AS high FROM quantiles),
chosen AS (
  SELECT a.lang, a.source, r.rule,
    CASE WHEN a.total >= {quality.ENOUGH} THEN x.low WHEN b.total >= {quality.ENOUGH} THEN y.low ELSE z.low END AS low,
    CASE WHEN a.total >= {quality.ENOUGH} THEN x.high WHEN b.total >= {quality.ENOUGH} THEN y.high ELSE z.high END AS high
  FROM (SELECT DISTINCT lang, source, total FROM fences WHERE level = 0) a
  JOIN (SELECT DISTINCT lang, total FROM fences WHERE level = 1) b USING (lang)
  CROSS JOIN (SELECT DISTINCT rule FROM fences) r
  LEFT JOIN fences x ON x.level = 0 AND x.lang = a.lang AND x.source = a.source AND x.rule = r.rule
  LEFT JOIN fences y ON y.level = 1 AND y.lang = a.lang AND y.rule = r.rule
  LEFT JOIN fences z ON z.level = 3 AND z.rule = r.rule),
outside AS (
  SELECT DISTINCT doc_id FROM tall JOIN chosen USING (lang, source, rule) WHERE value < low OR value > high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM counts JOIN failed USING (doc_id)"""


# Every kept term with every source of its language.
SOURCE_DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {divergence.LEAST_DOCUMENTS}),
langs AS (SELECT lang, coalesce(sum(n), 0) AS n_lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n_group FROM groups LEFT JOIN cells USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + ({divergence.SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (n_group + 2 * v)::HUGEINT AS p,
    1 + ({divergence.SCALE}::HUGEINT * (k.n + 2)) // (n_lang + 2 * v)::HUGEINT AS q
  FROM totals g JOIN langs USING (lang) JOIN kept k ON k.lang = g.lang
  LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM grid WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""

_MARKS = [infilling.SENTINELS[at : at + 3].decode() for at in range(0, 9, 3)]

def _infilling() -> str:
    def output(order) -> str:
        return " || ".join(f"'{_MARKS[part]}' || {('prefix', 'suffix', 'middle')[part]}" for part in order)

    def rebuilt(order) -> str:
        """The parts found again in the output, in reading order."""
        found = {}
        for place, part in enumerate(order):
            start = f"strpos(output, '{_MARKS[part]}') + 3"
            end = f"strpos(output, '{_MARKS[order[place + 1]]}')" if place < 2 else "length(output) + 1"
            found[part] = f"substring(output, {start}, {end} - ({start}))"
        return " || ".join(found[part] for part in infilling.READING_ORDER)

    holds = " OR ".join(f"contains(text, '{mark}')" for mark in _MARKS)
    numbers = ", ".join(f"('0x' || substring(hex, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    outputs = " ".join(f"WHEN '{form}' THEN {output(order)}" for form, order in infilling.ORDERS.items())
    texts = " ".join(f"WHEN '{form}' THEN {rebuilt(order)}" for form, order in infilling.ORDERS.items())
    return f"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('{infilling.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
drawn AS (SELECT doc_id, text, n, {numbers} FROM own),
formed AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR {holds} OR h3 % 100 >= {infilling.FORMED_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {infilling.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1, n - hi) AS suffix FROM formed),
put AS (SELECT *, CASE form {outputs} ELSE text END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form {texts} ELSE output END) AS restored_sha256 FROM put"""


# Every vector with every one of its label; equal to the indexed search where its recall is 1.
NEAR_VECTORS = f"""
WITH RECURSIVE own AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM own a JOIN own b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {embeddings.LIMIT}),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_id ON id = vec_id"""


ORACLE: dict[str, str] = {
    "op1_minhash_dedup": NEAR_DUPLICATES,
    "op6_quality_rules": _quality(),
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op12_fill_in_middle": _infilling(),
    "op13_embedding_dedup": NEAR_VECTORS,
}
