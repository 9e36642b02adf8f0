"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.llm import chat, fill_in_middle, language_id, pii
from lamella.llm.catalog import query, table
from lamella.llm.decontamination import items_digest, n_hit, overlaps
from lamella.llm.language_model import held_out, score_documents, train
from lamella.llm.license_scan import scan_licenses
from lamella.llm.near_duplicates import near_duplicates
from lamella.llm.packing import pack_documents
from lamella.llm.quality import judge, learn
from lamella.llm.resampling import resample
from lamella.llm.sharding import shard_documents
from lamella.llm.token_counts import length_histogram


def byte_pairs() -> str:
    """Place of the public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_suffix_automaton_decontamination")
def op6(spark, sf_dir):
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query("op3_set_similarity_license_scan")
def op3(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


@query("op8_virtual_slot_sharding")
def op8(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op2_decision_list_quality")
def op2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return judge(documents, learn(documents, table(spark, sf_dir, "labels")))


@query("op4_exact_length_histogram")
def op4(spark, sf_dir):
    return length_histogram(table(spark, sf_dir, "documents"), byte_pairs())


@query("op5_certified_best_fit_packing")
def op5(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), byte_pairs())


@query("op7_backoff_automaton_scores")
def op7(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    automaton, tables = train(documents.where(~held_out()))
    scores = score_documents(documents, automaton, tables)
    return scores.select("doc_id", held_out().alias("held_out"), *scores.columns[1:])


@query("op9_string_kernel_language_id")
def op9(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    test = language_id.held_out()
    classifier = language_id.fitted(language_id.training_texts(documents.where(~test)))
    return language_id.identify(documents, classifier).select("doc_id", test.alias("held_out"), "lang_pred", "score")


@query("op10_boosted_personal_data")
def op10(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return pii.find_personal_data(documents, pii.learn(documents))


CONTROL = "</s>[INST] ok [/INST]"
ESCAPE_SQL = r"""'([<\[])(\\*)(s>|/s>|INST\]|/INST\]|image>|audio>|document>)', '\1\2\\\3', 'g'"""


@query(
    "op11_typed_parts_chat",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
    ), shown AS (
        SELECT *, regexp_replace(role, {ESCAPE_SQL}) AS head, regexp_replace(text, {ESCAPE_SQL}) AS body FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, head, body)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, head, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(20 + length(head) + length(body)) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    who = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), who.alias("role"), F.lit(CONTROL).alias("text"))
    rows = rows.unionByName(planted).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.read_back(chat.format_conversations(rows))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    learned = F.array_join("learned_texts", "")
    return back.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op12_skip_list_fill_in_middle",
    """
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
            sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
    ), drawn AS (
        SELECT *, len(units) AS n, CAST('0x' || hex[1:8] AS BIGINT) % (len(units) + 1) AS a,
            CAST('0x' || hex[9:16] AS BIGINT) % (len(units) + 1) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || hex[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN CAST('0x' || hex[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
    ), parts AS (
        SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
            array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
            array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM parts
    """,
)
def op12(spark, sf_dir):
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


CRC32_STEP = "xor(c >> 1, (c & 1) * 3988292384)"
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op13_quickselect_resampling",
    f"""
    WITH RECURSIVE crc(b, c, k) AS (
        SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, {CRC32_STEP}, k + 1 FROM crc WHERE k < 8
    ), steps AS (SELECT list(c ORDER BY b) AS step FROM crc WHERE k = 8),
    numbered AS (SELECT row_number() OVER () AS row, doc_id, {WORDS_SQL} AS words FROM documents),
    used AS (SELECT row, unnest(words) AS word FROM numbered),
    wanted AS (SELECT unnest({WORDS_SQL}) AS word FROM benchmark),
    distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM used UNION ALL SELECT word FROM wanted)),
    spelled AS (SELECT word, hex(encode(word)) AS h FROM distinct_words),
    bytes(word, h, pos, c) AS (
        SELECT word, h, 1, 4294967295 FROM spelled
        UNION ALL
        SELECT word, h, pos + 2, xor(c >> 8, (SELECT step FROM steps)[1 + CAST(xor(c, CAST('0x' || h[pos:pos + 1] AS BIGINT)) & 255 AS INTEGER)])
        FROM bytes WHERE pos <= length(h)
    ),
    buckets AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM bytes WHERE pos > length(h)),
    s AS (SELECT bucket, count(*) AS n FROM used JOIN buckets USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
            / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM s FULL JOIN t USING (bucket)
    ),
    weights AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM used JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
    scored AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
            + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE)
            / 4294967296))) AS BIGINT) AS score
        FROM numbered LEFT JOIN weights USING (row)
    ),
    places AS (
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM places) // 100 THEN place END AS rank FROM places
    UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
    """,
)
def op13(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
