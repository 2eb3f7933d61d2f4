"""DuckDB SQL for the queries that it can express, written from their definitions."""

from __future__ import annotations

from palletwatch.llm.quality_references import REFERENCES

# Words are runs of anything but space and tab to carriage return.
WORDS = r"""
words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
)"""

OP5 = rf"""
WITH {WORDS},
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS seq
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
),
repeats AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM repeats),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
    FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


# Shards take turns: each turn claims the first slot of the shard's order that is still free.
OP1 = """
WITH RECURSIVE shards AS (
    SELECT list('shard-' || lpad(i::VARCHAR, 2, '0') ORDER BY i) AS names FROM range(32) t(i)
),
preferences AS (
    SELECT names,
        list_transform(names, lambda n: ('0x' || substr(md5('offset:' || n), 1, 8))::BIGINT % 4099) AS start,
        list_transform(names, lambda n: ('0x' || substr(md5('skip:' || n), 1, 8))::BIGINT % 4098 + 1) AS skip
    FROM shards
),
turns AS (
    SELECT 0 AS turn, list_transform(range(4099), lambda x: -1) AS owner, NULL::BIGINT AS slot
    UNION ALL
    SELECT turn + 1,
        list_transform(owner, lambda o, i: CASE WHEN i - 1 = claimed THEN turn % 32 ELSE o END), claimed
    FROM (
        SELECT turn, owner, list_filter(
            list_transform(range(4099), lambda j: (start[turn % 32 + 1] + j * skip[turn % 32 + 1]) % 4099), lambda s: owner[s + 1] = -1
        )[1] AS claimed
        FROM turns, preferences WHERE turn < 4099
    )
),
slots AS (SELECT slot, names[(turn - 1) % 32 + 1] AS shard FROM turns, shards WHERE slot IS NOT NULL),
placed AS (
    SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4099 AS slot FROM documents
)
SELECT doc_id, slot, shard FROM placed JOIN slots USING (slot)
"""


CHARACTERS = {
    "c0": "[^a-z]", "c1": "[^A-Z]", "c2": "[^0-9]", "c3": r"[^\x20\x09-\x0D]", "c4": r"""[^.,;:!?''"()-]""",
    "c6": r"[\x00-\x7F]",
}
COMMON = """
    the of and to in a is that for it on with as was be by are or an from at this not have
    le la les un une de du des et en à dans par pour que qui est il elle au sur ne pas avec
    der die das den dem des ein eine und in zu von mit auf für ist im nicht sich als auch es
    el la los las un una de del y en a que por para con no se su es al lo como más
""".split()
COMMON = list(dict.fromkeys(COMMON))

BINS = {"char": [f"c{i}" for i in range(7)], "word": [*COMMON, ""]}
FIXED = ", ".join(
    f"('{kind}', '{lang}', '{name}', {n})"
    for lang, counts in REFERENCES.items() for (kind, names), of in zip(BINS.items(), counts, strict=True)
    for name, n in zip(names, of, strict=True) if n
)
# A language tag counts up to its first - or _, in lower case. Texts without one, or in a language without a reference, are compared with
# every reference, and the nearest counts; by words only if they have no tag.
OP2 = rf"""
WITH {WORDS},
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS seq
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
),
repeats AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, seq) > 1),
covered AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM repeats) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
),
base AS (
    SELECT doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, w
    FROM documents JOIN words USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
failing AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
characters AS (
    SELECT doc_id, unnest(['c0', 'c1', 'c2', 'c3', 'c4', 'c6']) AS bin,
        unnest([{", ".join(f"length(regexp_replace(text, '{drop}', '', 'g'))" for drop in CHARACTERS.values())}]) AS n
    FROM failing
),
char_bins AS (
    FROM characters UNION ALL
    SELECT doc_id, 'c5', length(text) - total FROM failing JOIN (SELECT doc_id, sum(n) AS total FROM characters GROUP BY doc_id) USING (doc_id)
),
spoken AS (
    SELECT doc_id, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM failing
),
word_bins AS (
    SELECT doc_id, CASE WHEN word IN ({", ".join(f"'{w}'" for w in COMMON)}) THEN word ELSE '' END AS bin, count(*) AS n
    FROM spoken GROUP BY ALL
),
histograms AS (
    SELECT 'char' AS kind, doc_id, bin, n FROM char_bins WHERE n > 0 UNION ALL SELECT 'word', doc_id, bin, n FROM word_bins
),
sized AS (SELECT *, n / sum(n) OVER (PARTITION BY kind, doc_id) AS p FROM histograms),
fixed(kind, lang, bin, n) AS (VALUES {FIXED}),
reference AS (SELECT kind, lang, bin, n / sum(n) OVER (PARTITION BY kind, lang) AS q FROM fixed),
names AS (SELECT DISTINCT lang FROM fixed),
tagged AS (SELECT *, lower(regexp_extract(trim(coalesce(lang, '')), '^[^-_]*')) AS tag FROM failing),
compared AS (
    SELECT doc_id, kind, names.lang FROM tagged, names, (VALUES ('char'), ('word')) AS kinds(kind)
    WHERE tag = names.lang OR tag NOT IN (FROM names) AND (kind = 'char' OR tag = '')
),
-- Both shares matter in every bin that either has; bins of the reference alone add half their share.
shared AS (
    SELECT kind, doc_id, lang, sum(p * log2(2 * p / (p + coalesce(q, 0)))) AS from_doc,
        sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) AS from_reference, sum(coalesce(q, 0)) AS met
    FROM sized JOIN compared USING (kind, doc_id) LEFT JOIN reference USING (kind, lang, bin) GROUP BY kind, doc_id, lang
),
distances AS (
    SELECT doc_id, min(CASE WHEN kind = 'char' THEN d END) AS char_distance, min(CASE WHEN kind = 'word' THEN d END) AS word_distance
    FROM (SELECT kind, doc_id, sqrt(greatest((from_doc + from_reference + (1 - met)) / 2, 0)) AS d FROM shared) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (length(text) >= 400 AND coalesce(char_distance, 0) > 0.31)
        AND NOT coalesce(word_distance, 0) > CASE
            WHEN n_words >= 200 THEN 0.25 WHEN n_words >= 100 THEN 0.30 WHEN n_words >= 50 THEN 0.36 WHEN n_words >= 20 THEN 0.40 ELSE 1 END AS kept
FROM failing LEFT JOIN distances USING (doc_id)
"""

# Counts are those of all other documents; what no other document has is left to the order below, times alpha.
OP8 = rf"""
WITH {WORDS},
places AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
triples AS (
    SELECT *, lag(word) OVER in_order AS b, lag(word, 2) OVER in_order AS a
    FROM places WINDOW in_order AS (PARTITION BY doc_id ORDER BY i)
),
ones AS (SELECT doc_id, word, sum(count(*)) OVER (PARTITION BY word) - count(*) AS n FROM places GROUP BY doc_id, word),
twos AS (SELECT doc_id, b, word, sum(count(*)) OVER (PARTITION BY b, word) - count(*) AS n FROM triples WHERE b IS NOT NULL GROUP BY doc_id, b, word),
threes AS (SELECT doc_id, a, b, word, sum(count(*)) OVER (PARTITION BY a, b, word) - count(*) AS n FROM triples WHERE a IS NOT NULL GROUP BY doc_id, a, b, word),
total AS (SELECT count(*) AS n FROM places),
scored AS (
    SELECT t.doc_id, CASE
        WHEN threes.n > 0 THEN ln(threes.n / pair_before.n)
        WHEN twos.n > 0 THEN ln(twos.n / word_before.n) + CASE WHEN t.a IS NOT NULL THEN ln(0.4::DOUBLE) ELSE 0 END
        ELSE ln(CASE WHEN ones.n > 0 THEN ones.n::DOUBLE ELSE 0.4 END / greatest(total.n - size, 1))
            + ln(0.4::DOUBLE) * ((t.a IS NOT NULL)::INTEGER + (t.b IS NOT NULL)::INTEGER) END AS s
    FROM triples t CROSS JOIN total JOIN ones ON ones.doc_id = t.doc_id AND ones.word = t.word
    LEFT JOIN ones AS word_before ON word_before.doc_id = t.doc_id AND word_before.word = t.b
    LEFT JOIN twos ON twos.doc_id = t.doc_id AND twos.b = t.b AND twos.word = t.word
    LEFT JOIN twos AS pair_before ON pair_before.doc_id = t.doc_id AND pair_before.b = t.a AND pair_before.word = t.b
    LEFT JOIN threes ON threes.doc_id = t.doc_id AND threes.a = t.a AND threes.b = t.b AND threes.word = t.word
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(sum(s), 0.0), 6) AS log_score
FROM words LEFT JOIN scored USING (doc_id) GROUP BY ALL
"""

NORMAL = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'
), lambda x: x <> '')"""

OP9 = f"""
WITH item_words AS (SELECT item_id, {NORMAL} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM item_words WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS seq
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
),
doc_words AS (SELECT doc_id, {NORMAL} AS w FROM documents),
runs AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS seq
    FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
    )
),
found AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, seq)),
hit AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM found) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Equal sets are one class; classes are linked by counting the shingles that each two of them share.
OP12 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
    ), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
    FROM words
),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT id, n, unnest(s) AS x FROM classes),
links AS (
    SELECT a.id AS a, b.id AS b FROM members a JOIN members b ON a.x = b.x AND a.id < b.id
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT id AS a, id AS b FROM classes UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
components AS (SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN components USING (id)
"""

OP13 = f"""
WITH terms AS (SELECT doc_id, {NORMAL} AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM terms),
counted AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM terms) GROUP BY doc_id, term
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, total GROUP BY term
),
asked AS (
    SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({NORMAL}) AS term FROM benchmark) GROUP BY ALL
),
scored AS (
    SELECT item_id, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * counted.n * total.n) // total.l))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

# Scores of a trained model, trees, fingerprints, records and token ids are beyond SQL; tests check them by brute force.
ORACLE: dict[str, str] = {
    "op1_lookup_sharding": OP1,
    "op2_fixed_divergence": OP2,
    "op5_super_kmer_dedup": OP5,
    "op8_trigram_backoff": OP8,
    "op9_suffix_automaton": OP9,
    "op12_tensored_minhash": OP12,
    "op13_block_max_maxscore": OP13,
}
