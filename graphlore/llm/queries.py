"""The query of each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.llm import chat_format, exact_dedup, license_scan, lm_scoring, mixing, near_join, prefix_trie, quality_rules, secret_scan, sentencepiece_codec, spelling_groups, suffix_dedup, toxicity

EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, then reads turns and loss mask back from the formatted text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], rows.schema)
    done = chat_format.format_chat(chat_format.canonical_turns(rows.unionByName(extra), "conv_id"))
    done = done.select("conv_id", "formatted", chat_format.parse_chat(F.col("formatted")).alias("read"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return done.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_Q4 = """
words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
base AS (
  SELECT words.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols / CAST(greatest(n_words, 1) AS DOUBLE) AS symbol_rate, word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS word_length,
    n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) AS dup_line_rate
  FROM base),
"""


def _op4_sql() -> str:
    def limits(name: str, by: str) -> str:
        cols = ", ".join(
            f"quantile_disc({f}, 0.75) + {quality_rules.FENCE} * (quantile_disc({f}, 0.75) - quantile_disc({f}, 0.25)) + {s} AS {name}_{f}"
            for f, s in quality_rules.FEATURES.items())
        return f"{name} AS (SELECT {by}, {cols} FROM rated WHERE NOT base_failed GROUP BY {by})"

    within = " AND ".join(f"coalesce({f} <= least(own_{f}, every_{f}), true)" for f in quality_rules.FEATURES)
    return f"""WITH {_Q4.replace(chr(92) * 2, chr(92))} {limits('own', 'lang, source')}, {limits('every', 'lang')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM rated LEFT JOIN own ON rated.lang IS NOT DISTINCT FROM own.lang AND rated.source IS NOT DISTINCT FROM own.source
LEFT JOIN every ON rated.lang IS NOT DISTINCT FROM every.lang"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources at weights 1, 2, 3 repeating, no source more than three times."""
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.joined(of(*secret_scan.BASE)), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = sentencepiece_codec.round_trip(docs).drop("text")
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _canonical_sql(x: str) -> str:
    """Written out here, not taken from the operator's tables, so that the one is held against the other."""
    spelt = (
        (" licenc", " licens"), (" sub licens", " sublicens"), (" organis", " organiz"), (" authoris", " authoriz"), (" recognis", " recogniz"),
        (" utilis", " utiliz"), (" realis", " realiz"), (" favour", " favor"), (" behaviour", " behavior"), (" e mail", " email"),
        (" non commercial", " noncommercial"), (" whilst ", " while "), (" per cent ", " percent "), (" merchantibility ", " merchantability "), (" fulfilment ", " fulfillment "),
    )
    x = rf"regexp_replace(lower({x}), '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$', ' ', 'g')"
    x = rf"' ' || regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    x = f"replace(replace({x}, '  ', ' '), '  ', ' ')"
    for before, after in spelt:
        x = f"replace({x}, '{before}', '{after}')"
    return f"sha256({x})"


#: Licences and digests of the canonical forms of their texts and notices; fixed values.
OP9_KNOWN = """
  ('0BSD', 'a65e75d1143c13ab3ec48ecb3eb1a5c4d027f27dece6853b821abe188b521244'),
  ('Apache-2.0', '09e02350ed1aee730192e270be576bb6a819255b51e916d0c8c8947b4f298e24'),
  ('Apache-2.0', '6b837003b475e68b638934fe59cf5a80fd42aaac706b018e5e9953cd03b6d609'),
  ('Apache-2.0', '91788a58d686f795b99385623baaebc235921baf52ec95d14bb86e859e580352'),
  ('Apache-2.0', 'a926a90b3c0a8655acc39a762385451ec7780a40ff51efcebbe1aa61f276fb07'),
  ('Apache-2.0', 'ec52e3c4715dc561faeba3ee7bcef8fa84b75d90bfb866e1b2fc49c40beb3cf4'),
  ('Artistic-1.0-Perl', '156ea114802e980c9f8581dd18b8b55a8361edd115f7fe75024213e44424ed7e'),
  ('BSD-2-Clause', '192d35a841fe222e07817cf3c28ce58e977a221de0ff1edd99bf5c3109ac1c3c'),
  ('BSD-3-Clause', '48c8a35a4353dae3524b849cfd2c781b3c935e964f465e15fb0bc23f23cf96ad'),
  ('BSD-3-Clause', '7062b9e3c23606a194c78bcdf5583467428d17586d2b63f47d28b95b7d8c49b9'),
  ('CC-BY-4.0', 'cdeaaf75e4f5b638ae8c9718870219cedf3a85fcabc6f8e6ee359069456acd30'),
  ('CC-BY-4.0', 'f816f21f4420347fa741b3af9be15757208b07426dad7ec088be419361174ff1'),
  ('CC-BY-NC-4.0', '42bf3a899a587639fee0fc60c1877a2924834b1f4d5bbc942056d405d683d6bb'),
  ('CC-BY-SA-4.0', '3b718e1a633106726686fa3754f070e7c9b908ed2fa5ee2bdf05b4c080d18453'),
  ('CC0-1.0', '3e6e368fd02abd67188d1bf25b196ac79f5782b2079e9579134c5e3f71f9ab74'),
  ('GFDL-1.2', 'aea6038a701fc689af000f5d68aea404e3b4687ea875aea0e78acfd5dd6dfeee'),
  ('GFDL-1.3', 'caa7b41c65ff5e92e1ba9af89759decfd1356c2acf3e1e5e238c3b7a7e5337f7'),
  ('GPL-1.0', '33d98ff41562c09dfe36872170aead2a9e1e374cee5b97fd749ca83088665e41'),
  ('GPL-2.0', '2459d0b759a85e7f8584d32ab04131d27dab1b6fd11644fcaf2fc5caf8db2ae7'),
  ('GPL-3.0', 'c06ae785e05bae8fedc78e8c501b49df1828729eac7c2498116eaa2b067dd6d9'),
  ('GPL-3.0', 'cad5ad1023dcebf1c4ff9868d210ebac5434cfc33cac6da8946a0694c9b52671'),
  ('GPL-3.0', 'd60c230a33a8c40d7faa034ed52950460f8168d531aa2f2abcce422231eaf48f'),
  ('GPL-3.0-only', '89af127481d75b43259bf3ede3c843077d78059202d7e2dd7e69f8373daa3c26'),
  ('ISC', 'a17531580345f1fdc23198acfcee0adeaaf5670cde59f746853dbe83ff33f195'),
  ('ISC', 'a66cef35e79fdf6588fc829e48a5641c9cc1e821919d3732d1ec78be85e3622b'),
  ('LGPL-2.0', '954890b464598853673509c334974ad7f9ab367de826784aea2071f5ba278174'),
  ('LGPL-2.1', '9b69d00b4bccc9b1926b5da285024ec98a15727a8e9a5388aa118b10f4a79cf0'),
  ('LGPL-3.0', 'f0cae4b317f4f263dca8e79625f8d9c7618c87e0ca6665c79b0f1c12ac856938'),
  ('MIT', '1038ebc65831df94f10cce77d97edd471f1cf637c51c6e6283cb8ad8601b86bc'),
  ('MIT', '56b4180c92be5357422868e9e33a8722c9a693afe4997f38910b3ad420bd8646'),
  ('MIT', '5a992b1e26607fec3b8b25029e03d0b5c75684b2557ffd51f5e29dbe9c4fa8e7'),
  ('MIT', '810574160cef45492589cc3a62e80658ebeb10b1ec06c4cdc94019d4cdcd11a7'),
  ('MIT', 'a1a07d39477e8de9a829d6c574ded5f6881a3295d667164b6dacbc82ae320091'),
  ('MIT', 'cf8155ce82ea64f0389b0b15d95913ebeec2d29d2b3cf37f4af89cdb23c3d49d'),
  ('MIT', 'd14596bbf68570a924b84fa861d8b4932719b6b3d16ba83460d34aaa39a194ac'),
  ('MPL-1.1', '260b601de5d5e5ec00bd903c42a1ac3b0cf3eebd7b1e529b025961a8d981cb56'),
  ('MPL-2.0', 'a90ba5346ad1927fede05edb2d96afdd4948d68d16cef5d29e84239426134356'),
  ('Unlicense', 'af6569657d66e59605c0ac493c85eea3f5f2a64128879b081d0a5ca46cb1d5f9'),
  ('Unlicense', 'd838b4ad7073104ee15e8c7c02b134fb97d6e7602a159234aa4442c186c953f7'),
  ('Unlicense', 'e036143787b9efdafaaf5676f94dbb07ab0e77c34f182f2481cac2660851fc4b')
"""
OP9_SQL = f"""WITH known(license, digest) AS (VALUES {OP9_KNOWN}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notice_licenses, count(*) AS n_notices
  FROM lines JOIN known ON {_canonical_sql('line')} = known.digest WHERE regexp_matches(line, '(?i)licen|permission|redistribution') GROUP BY doc_id),
whole AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS text_digest FROM documents)
SELECT doc_id, text_digest, license AS text_license, coalesce(notice_licenses, '') AS notice_licenses, coalesce(n_notices, 0) AS n_notices
FROM whole LEFT JOIN known ON text_digest = known.digest LEFT JOIN notices USING (doc_id)"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every text under unigrams and under the interpolated model, learned from four fifths of the texts."""
    return lm_scoring.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its first turns borrowed from the hundredth before it."""
    turns = prefix_trie.digested(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(prefix_trie.sequences(prefix_trie.with_borrowed_heads(turns)))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least seven letters, its neighbours one edit away and the form that it is a slip of."""
    return spelling_groups.variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc32_sql(data: str) -> str:
    """CRC-32 of a blob, bit by bit."""
    at = lambda k: f"instr('123456789ABCDEF', substr(hex({data}), CAST({k} AS BIGINT), 1))"
    bits = f"list_transform(range(0, 8 * octet_length({data})), lambda i: ((CASE WHEN i % 8 < 4 THEN {at('2 * (i // 8) + 2')} ELSE {at('2 * (i // 8) + 1')} END) >> (i % 4)) & 1)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295)"


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("encode(CAST(conv_id AS VARCHAR))")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
whole AS (
  SELECT conv_id, place, role, text FROM turns JOIN convs USING (conv_id) WHERE place > h
  UNION ALL SELECT convs.conv_id, place, role, text FROM convs JOIN turns ON convs.base = turns.conv_id WHERE place <= h),
listed AS (
  SELECT conv_id, count(place) AS n, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS d,
    coalesce(list(length(text) ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS l
  FROM convs LEFT JOIN whole USING (conv_id) GROUP BY conv_id),
begun AS (SELECT conv_id, n, k AS depth, array_to_string(d[:k], '') AS node, array_to_string(d[:k - 1], '') AS up, l[k] AS len FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM listed)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, coalesce(min(len), 0) * (count(*) - 1) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM begun GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up, depth),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
over AS (SELECT substr(node, 1, 32 * k) AS node, k AS depth, own, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted)),
below AS (SELECT node, depth, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM over GROUP BY node, depth)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, below.n_leaves, CAST(saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (node, depth) LEFT JOIN counted p ON c.depth = p.depth + 1 AND c.up = p.node
"""
OP13_SQL = f"""
WITH runs AS (
  SELECT doc_id, run, count(*) AS k, {_crc32_sql("encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM runs)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gaps AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
near AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, word := encode(other))) AS best FROM pairs GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.less >= 10 * n THEN decode(best.word) END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN near USING (word)),
steps AS (
  WITH RECURSIVE up AS (
    SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT up.word, formed.form, step + 1 FROM up JOIN formed ON up.root = formed.word WHERE formed.form IS NOT NULL)
  SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN steps USING (word)
"""


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_source_mix, op3_secret_scan, op4_quality_rules, op5_sentencepiece, op6_toxicity, op7_exact_dedup, op8_suffix_dedup, op9_license_scan, op10_jaccard_join, op11_lm_score, op12_prefix_trie, op13_spelling_groups)}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op4_quality_rules": _op4_sql(), "op7_exact_dedup": OP7_SQL, "op9_license_scan": OP9_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling_groups": OP13_SQL}
