"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm import dyadic, exact_dedup, infill, langid, license_scan, media, ngram_join, packing, pii, quality, spelling, spm, token_store


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests; odd rows as in ``spm.round_trip``."""
    return spm.round_trip(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document; odd rows as in ``exact_dedup.exact_dedup``."""
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document; odd rows as in ``license_scan.license_scan``."""
    return license_scan.license_scan(_documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of similar documents; odd rows as in ``ngram_join.jaccard_components``."""
    return ngram_join.jaccard_components(_documents(spark, sf_dir), words=4, percent=85)


def op5_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their places; odd rows as in ``packing.best_fit_pack``."""
    return packing.best_fit_pack(_documents(spark, sf_dir))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates; odd rows as in ``pii.replace_pii``."""
    return pii.replace_pii(_documents(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media file, read back; odd rows as in ``media.media_column``."""
    return media.media_digest(media.media_column(_documents(spark, sf_dir)))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from files; odd rows as in ``token_store.token_store``."""
    return token_store.token_store(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; odd rows as in ``quality.classify``."""
    return quality.classify(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; odd rows as in ``langid.language_id``."""
    return langid.language_id(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text by lines, in PSM or SPM form, as digests; odd rows as in ``infill.fill_in_middle``."""
    return infill.infill_digest(infill.fill_in_middle(_documents(spark, sf_dir)))


def op12_power_of_two_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of power-of-two lengths; odd rows as in ``dyadic.power_of_two_pack``."""
    return dyadic.packing_digest(dyadic.power_of_two_pack(_documents(spark, sf_dir)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its form and root; odd rows as in ``spelling.spelling_variants``."""
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_exact_dedup,
        op3_license_scan,
        op4_ngram_jaccard,
        op5_best_fit_pack,
        op6_pii_surrogates,
        op7_media_columns,
        op8_token_store,
        op9_quality,
        op10_language_id,
        op11_fill_in_middle,
        op12_power_of_two_pack,
        op13_spelling_variants,
    )
}


def _license_sql() -> str:
    """The scan in SQL: sentences by splitting, identifiers by a map, one step per rule."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"{text(n)}: {text(i)}" for n, i in license_scan._known().items())
    flat = f"regexp_replace(coalesce(text, ''), {text(license_scan._WRAP)}, ' ' || chr(92) || '1', 'g')"
    for inner, shown in license_scan._INNER:
        flat = f"regexp_replace({flat}, {text(inner)}, {text(shown)}, 'g')"
    steps, last = [], "r0"
    for i, (name, run) in enumerate(license_scan.RULES, 1):
        pattern = text("|" + "||".join(run) + "|")
        steps.append(
            f"r{i} AS (SELECT doc_id, ids, replace(rest, {pattern}, '|#|') AS rest, CASE WHEN contains(rest, {pattern}) AND NOT list_contains(found, {text(name)})"
            f" THEN list_append(found, {text(name)}) ELSE found END AS found FROM {last})"
        )
        last = f"r{i}"
    return f"""
        WITH parts AS (
            SELECT doc_id, list_transform(string_split_regex({flat}, {text(license_scan._END)}), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))) AS p
            FROM documents
        ), named AS (
            SELECT doc_id, list_filter(list_transform(p, lambda x: MAP {{{known}}}[x]), lambda x: x IS NOT NULL) AS ids FROM parts
        ), r0 AS (
            SELECT doc_id, ids, '|' || array_to_string(list_transform(ids, lambda x: x || '|'), '|') AS rest, CAST([] AS VARCHAR[]) AS found FROM named
        ), {", ".join(steps)}
        SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licenses FROM {last}
    """


ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": _license_sql(),
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), grams AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b USING (g) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.c
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id
        FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
    """,
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT norm, count(*) AS group_size, sha256(norm) AS text_sha256,
                   first(doc_id ORDER BY n_points DESC, doc_id ASC NULLS LAST) AS keep_id
            FROM t GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM t JOIN g USING (norm)
    """,
    "op11_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), drawn AS (
            SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS h FROM cut
        ), placed AS (
            SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                           WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                   least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b
            FROM drawn
        ), parts AS (
            SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m,
                   coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s
            FROM placed
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), CAST(b AS BIGINT))) AS t
        ), runs AS (
            SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL
        ), hashed AS (
            SELECT w, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
                                 lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
            FROM runs, crc
        ), words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
        ), less AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), pairs AS (
            SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT word, rest FROM less JOIN (SELECT word AS rest FROM words) USING (rest)
            UNION SELECT rest, word FROM less JOIN (SELECT word AS rest FROM words) USING (rest)
        ), near AS (
            SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs JOIN words ON words.word = b GROUP BY a
        ), forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
            FROM words LEFT JOIN near USING (word)
        ), chain AS (
            SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next
        )
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
    """,
}
