"""Queries on texts: clean-up, names, tokens and extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions import extract as E
from gridline.functions import mojibake
from gridline.functions import text as X
from gridline.model import TRANSLITERATION
from gridline.operators import inflect, ocrtext
from gridline.plans.register import register, table
from gridline.session import spread
from gridline.sources import text as text_source

_ICONS = {".html": "🌐", ".pdf": "📕", ".txt": "📄"}


@register(
    "normalize_cells",
    r"""SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\s+', ' ', 'g')) AS normalized,
      trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS pdf_cell,
      regexp_matches(replace(replace(replace(text, '.', ''), ',', ''), '-', ''), '^\p{Nd}+$') AS numeric FROM documents""",
)
def normalize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(t).alias("normalized"), X.pdf_cell(t).alias("pdf_cell"), X.is_number(t).alias("numeric"))


@register(
    "safe_names",
    r"""SELECT page_id, lower(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'file')) AS stem,
      lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')) || '_' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || '.html' AS name,
      url || ':' || octet_length(encode(html)) || ':' || md5(html) AS signature FROM pages""",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, content = F.col("url"), F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", X.safe_stem(url).alias("stem"), X.numbered_name(url, F.col("page_id") % 1000, F.lit(".HTML")).alias("name"), X.signature(url, content).alias("signature"))


_FROM, _RUSSIAN = "abcdefghijklmnopqrstuvwxyzABC", "абцдефжчизклмнопщрстувшыюяЮЁъ"
_SPELLED = reduce(lambda sql, p: f"replace({sql}, '{p[0]}', '{p[1]}')", [*TRANSLITERATION.items(), *((r.upper(), x.capitalize()) for r, x in TRANSLITERATION.items())], f"translate(text, '{_FROM}', '{_RUSSIAN}')")


@register("transliterate", f"SELECT doc_id, {_SPELLED} AS latin FROM documents")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Russian letters in place of most Latin ones, and back in Latin spelling."""
    return table(spark, sf_dir, "documents").select("doc_id", X.transliterate(F.translate("text", _FROM, _RUSSIAN)).alias("latin"))


@register(
    "field_names",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'manufacturer' ELSE regexp_replace(regexp_replace(trim(lower(p_name || ' ' || p_brand)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', '_', 'g') END AS field FROM part""",
)
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 == 0, "Производитель").otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", X.field_name(name).alias("field"))


@register(
    "file_icons_sizes",
    """WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 1024 + page_id * 128 ELSE (octet_length(encode(html)) * (page_id % 4 + 1) * [1, 97, 9973, 999983][page_id % 4 + 1])::BIGINT END AS n FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN '🌐' WHEN 1 THEN '📕' WHEN 2 THEN '📄' ELSE '📎' END AS icon,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size FROM s""",
)
def file_icons_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".HTML", ".pdf", ".txt", ".bin")]), (page % 4 + 1).cast("int"))
    factor = F.element_at(F.array(*[F.lit(n) for n in (1, 97, 9973, 999983)]), (page % 4 + 1).cast("int"))
    size = F.when(page % 5 == 0, 1024 + page * 128).otherwise((F.octet_length("html") * (page % 4 + 1) * factor).cast("long"))
    return table(spark, sf_dir, "pages").select("page_id", X.icon(F.concat(F.lit("page"), suffix), _ICONS).alias("icon"), X.human_size(size.cast("long")).alias("size"))


_TOKENS = r"""
p AS (
  SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]') AS w FROM documents
), t AS (
  SELECT doc_id, CAST(i AS INTEGER) AS pos, w[i + 1] AS token FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM p)
), k AS (
  SELECT *, CASE WHEN regexp_full_match(token, '\s+') THEN 'whitespace' WHEN regexp_matches(token, '\d') AND regexp_matches(token, '[a-z]') THEN 'word'
    WHEN regexp_full_match(token, '[A-ZА-Я]{1,3}\d{1,4}[A-ZА-Яа-я\d''.\-]*|[A-ZА-Яа-я]+\d+[A-ZА-Яа-я\d\-.]*|[A-Z]{2,}(?:\s+\d+)?|[A-ZА-Я]{2,}[A-ZА-Я]{2,}|[A-ZА-Я]{2}[A-ZА-Я]{2}\s*\d+') THEN 'technical'
    WHEN regexp_matches(token, '\d') AND regexp_matches(token, '[A-ZА-Я]') AND length(token) >= 3
      AND len(regexp_extract_all(token, '[A-ZА-Я]')) >= 0.7 * len(regexp_extract_all(token, '[A-Za-zА-Яа-я]')) THEN 'technical'
    WHEN regexp_full_match(token, '[\d.,]+') THEN 'numeric' WHEN regexp_matches(token, '[\p{Cyrillic}\p{Latin}]') THEN 'word' ELSE 'special' END AS kind
  FROM t
)"""


@register("token_types", f"WITH {_TOKENS} SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind")
def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    return docs.groupBy("doc_id", X.token_type(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "token_context",
    f"""WITH {_TOKENS}, n AS (
      SELECT *, coalesce(bool_or(kind = 'numeric') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false)
        OR coalesce(bool_or(kind = 'numeric') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) AS near FROM k)
    SELECT doc_id, pos, token FROM n WHERE kind = 'word' AND near""",
)
def token_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ocrtext.tokens(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.where("near_number AND kind = 'word'").select("doc_id", "pos", "token")


@register(
    "homoglyphs",
    r"""SELECT p_partkey, translate(p_name || ' ' || p_brand || ' ' || p_size, 'AaBEeKMHOoPpCcTtyXxruniINUY', 'АаВЕеКМНОоРрСсТтуХхгипіІПИУ') AS looks,
      translate(translate(p_name || ' ' || p_brand || ' ' || p_size, 'AaBEeKMHOoPpCcTtyXxruniINUY', 'АаВЕеКМНОоРрСсТтуХхгипіІПИУ'), '36', 'Зб') AS cyrillic,
      p_name || ' ' || p_brand || ' ' || p_size AS latin FROM part""",
)
def homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat_ws(" ", "p_name", "p_brand", "p_size")
    from gridline.model import LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN

    looks = F.translate(word, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)
    return table(spark, sf_dir, "part").select("p_partkey", looks.alias("looks"), X.to_cyrillic(word).alias("cyrillic"), X.to_latin(looks).alias("latin"))


@register(
    "ocr_clean",
    r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name || ' ' || p_size || 'шт' WHEN 1 THEN '1ехническое ' || p_name || ' “' || p_size || ' ШТ.”'
        WHEN 2 THEN p_name || '’s – ' || p_size || 'Шт. 3амена' ELSE p_name || ' , ' || p_brand END AS t FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(t, '^\s*-\s*(.*\d)шт$', '\1 шт.') WHEN 1 THEN replace(replace(replace(replace(t, '1ехническое', 'Техническое'), '“', '"'), '”', '"'), ' ШТ."', ' шт."')
        WHEN 2 THEN replace(replace(replace(replace(t, '’', ''''), '–', '-'), 'Шт.', ' шт.'), '3амена', 'Замена') ELSE t END AS cleaned FROM p""",
)
def ocr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("- "), name, F.lit(" "), size, F.lit("шт")))
        .when(kind == 1, F.concat(F.lit("1ехническое "), name, F.lit(" “"), size, F.lit(" ШТ.”")))
        .when(kind == 2, F.concat(name, F.lit("’s – "), size, F.lit("Шт. 3амена")))
        .otherwise(F.concat(name, F.lit(" , "), F.col("p_brand")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", X.ocr_clean(text).alias("cleaned"))


#: The length of the longest common subsequence of words w and terms t, a row of the table at a time: of a new
#: row, cell j is the largest of the old cell j and of old cells before an equal sign up to j, plus 1.
_COMMON = """
lcs AS (
  SELECT w, t, 0 AS i, list_transform(range(0, length(t) + 1), lambda j: 0) AS r FROM pairs
  UNION ALL SELECT w, t, i + 1, list_transform(range(0, length(t) + 1), lambda j: greatest(r[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: t[k] = w[i + 1]), lambda k: r[k] + 1)), 0)))
  FROM lcs WHERE i < length(w)
), score AS (SELECT w, t, 200.0::DOUBLE * r[length(t) + 1] / (length(w) + length(t)) AS s FROM lcs WHERE i = length(w))"""
_BRAND_TERMS = ", ".join("('" + v.replace("'", "''") + "', '" + b.replace("'", "''") + f"', {i})" for i, (v, b) in enumerate(X.brand_variants()))


@register(
    "brand_fuzzy",
    f"""WITH RECURSIVE w AS (SELECT p_partkey, replace(lower(['Sandvlk', 'lscar', 'Kenametal', 'D`Andrea', 'Waltar', 'unknown'][p_partkey % 6 + 1]), '`', '') AS word FROM part),
    terms AS (SELECT * FROM (VALUES {_BRAND_TERMS}) v(t, match, ord)), pairs AS (SELECT w, t FROM (SELECT DISTINCT word AS w FROM w), terms), {_COMMON.strip()},
    best AS (SELECT w, match, s FROM score JOIN terms USING (t) WHERE s >= 75 QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, ord) = 1)
    SELECT p_partkey, word, match, round(s, 6) AS score FROM w LEFT JOIN best ON best.w = w.word""",
)
def brand_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands found for disturbed spellings, by the longest common subsequence."""
    kinds = F.array(*[F.lit(b) for b in ("Sandvlk", "lscar", "Kenametal", "D`Andrea", "Waltar", "unknown")])
    words = table(spark, sf_dir, "part").select("p_partkey", X.brand_key(F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("word"))
    found = ocrtext.nearest(words, ocrtext.brands(spark), ocrtext.BRAND_SCORE)
    return words.join(found, "word", "left").select("p_partkey", "word", "match", F.round("score", 6).alias("score"))


@register(
    "brand_names",
    f"""WITH RECURSIVE b AS (SELECT p_partkey, regexp_replace(['Sandvlk', 'ISCAR', 'Kenametal', 'D`Andrea', 'Waltar', 'Nobody'][p_partkey % 6 + 1], '`', chr(39)) AS shown, p_name FROM part),
    k AS (SELECT *, replace(lower(shown), chr(39), '') AS word FROM b),
    terms AS (SELECT * FROM (VALUES {_BRAND_TERMS}) v(t, match, ord)), pairs AS (SELECT w, t FROM (SELECT DISTINCT word AS w FROM k), terms), {_COMMON.strip()},
    best AS (SELECT w, match FROM score JOIN terms USING (t) WHERE s >= 75 QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, ord) = 1)
    SELECT p_partkey, p_name || ' (' || CASE WHEN match IS NULL THEN shown ELSE ' ' || match || ' ' END || '), x' || shown AS text FROM k LEFT JOIN best ON best.w = k.word""",
)
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a disturbed brand in brackets, and once inside another word, where it stays."""
    kinds = F.array(*[F.lit(b) for b in ("Sandvlk", "ISCAR", "Kenametal", "D`Andrea", "Waltar", "Nobody")])
    kind = F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int"))
    cells = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" ("), kind, F.lit("), x"), kind).alias("text"))
    return ocrtext.canonical_brands(cells, ["p_partkey"])


@register(
    "ocr_repair",
    """WITH t AS (SELECT p_partkey, ['Резец', 'NЛACTUHA', 'державка', '5 шт.', 'CCMT120404', 'Sandvik', 'D''Andrea', 'патрон'] AS w FROM part)
    SELECT p_partkey, w[p_partkey % 8 + 1] || ' - ' || w[p_partkey % 7 + 1] AS text FROM t""",
)
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disturbed terms for each part, repaired by all passes."""
    terms = F.array(*[F.lit(w) for w in ("Pe3eц", "ПЛАСТИHА", "державkа", "5шт", "CCМТ120404", "Sandvlk", "D`Andrea", "паrрон")])
    noisy = F.concat_ws(" ", F.element_at(terms, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("-"), F.element_at(terms, (F.col("p_partkey") % 7 + 1).cast("int")))
    return ocrtext.repaired(table(spark, sf_dir, "part").select("p_partkey", noisy.alias("text")), ["p_partkey"])


#: Phrases, and pairs of tables: what they were written in and what they were read with; None stays as it is.
_PHRASES = ["Резец токарный", "Пластина 5 шт.", "ДЕРЖАВКА", "Сверло «по металлу»", "Über größere Brücken", "ER32"]
_MISREAD = [None, ("utf-8", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("utf-8", "latin-1", "utf-8", "latin-1")]


def _misread() -> list[tuple[str, str]]:
    """(text as it was read, phrase) of all phrases that the tables hold."""
    out = []
    for phrase in _PHRASES:
        for tables in _MISREAD:
            text = phrase
            try:
                for written, seen in zip((tables or ())[::2], (tables or ())[1::2], strict=True):
                    text = text.encode(written).decode(seen)
            except UnicodeError:
                continue
            out.append((text, phrase))
    return out


@register(
    "mojibake",
    f"""WITH t AS (SELECT {[w for _, w in _misread()]} AS w) SELECT 'part' AS source, p_partkey AS id, w[p_partkey % {len(_misread())} + 1] AS text FROM part, t
    UNION ALL SELECT 'misread', doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'clean', doc_id, text FROM documents WHERE text IS NOT NULL""",
)
def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in wrong tables, all documents read with a wrong one, and all as they are."""
    texts = F.array(*[F.lit(t) for t, _ in _misread()])
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.element_at(texts, (F.col("p_partkey") % len(_misread()) + 1).cast("int")).alias("text"))
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    kind = lambda name, text: F.struct(F.lit(name).alias("source"), F.col("doc_id").alias("id"), text.alias("text"))
    both = docs.select(F.inline(F.array(kind("misread", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")), kind("clean", F.col("text")))))
    return part.unionByName(both).withColumn("text", mojibake.repaired(F.col("text")))


#: Endings of three made-up classes.
_ENDINGS = [(0, ""), (0, "a"), (0, "ами"), (1, ""), (1, "ing"), (1, "g"), (1, "ed"), (2, "en"), (2, "e"), (2, "n"), (2, "s")]


@register(
    "inflected_words",
    f"""WITH s AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS stem FROM part), e AS (SELECT * FROM (VALUES {", ".join(f"({c}, '{x}')" for c, x in _ENDINGS)}) v(class, ending)),
    c AS (SELECT stem, CAST(length(stem) % 3 AS INTEGER) AS class, 'the ' || stem AS lemma FROM s UNION SELECT stem || 'in', 1, 'in ' || stem FROM s WHERE length(stem) % 2 = 0),
    w AS (SELECT p_partkey, upper(string_split(p_name, ' ')[1]) || ['', 'a', 'ами', 'ing', 'ed', 'en', 'ns', 'x'][p_partkey % 8 + 1] AS word FROM part),
    f AS (SELECT p_partkey, word, lemma, class, ending FROM w JOIN e ON ends_with(lower(word), ending) JOIN c USING (class) WHERE lower(word) = stem || ending
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(ending) DESC, lemma, class) = 1)
    SELECT p_partkey, w.word, lemma, class, ending FROM w LEFT JOIN f USING (p_partkey)""",
)
def inflected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of every part's name with an ending, analysed by paradigms of all names' words."""
    part = table(spark, sf_dir, "part")
    stem = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("stem")).distinct()
    other = stem.where("length(stem) % 2 = 0").select(F.concat("stem", F.lit("in")).alias("stem"), F.lit(1).alias("class"), F.concat(F.lit("in "), "stem").alias("lemma"))
    stems = stem.select("stem", (F.length("stem") % 3).alias("class"), F.concat(F.lit("the "), "stem").alias("lemma")).unionByName(other)
    endings = spark.createDataFrame(_ENDINGS, "class int, ending string")
    tails = F.array(*[F.lit(x) for x in ("", "a", "ами", "ing", "ed", "en", "ns", "x")])
    words = part.select("p_partkey", F.concat(F.upper(F.get(F.split("p_name", " "), F.lit(0))), F.element_at(tails, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("word"))
    return words.join(inflect.analysed(words, stems, endings), "word", "left").select("p_partkey", "word", "lemma", "class", "ending")


@register(
    "markdown_table",
    r"""WITH m AS (SELECT page_id, '| name | ' || (page_id % 7) || ' |' || chr(10) || '|---|---|' || chr(10) || 'talk' || chr(10) || '| a' || page_id || ' |  ' || url || ' |' AS t FROM pages)
    SELECT page_id, 0 AS row_idx, 'name' AS first_cell, CAST(page_id % 7 AS VARCHAR) AS last_cell FROM m
    UNION ALL SELECT page_id, 1, 'a' || page_id, trim(string_split(split_part(t, chr(10), 4), '|')[3]) FROM m""",
)
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    text = F.concat(F.lit("| name | "), (F.col("page_id") % 7).cast("string"), F.lit(" |\n|---|---|\ntalk\n| a"), page, F.lit(" |  "), F.col("url"), F.lit(" |"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(X.markdown_rows(text)).alias("row_idx", "cells"))
    return rows.select("page_id", "row_idx", F.get("cells", F.lit(0)).alias("first_cell"), F.element_at("cells", -1).alias("last_cell"))


@register(
    "model_answers",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS answer FROM conversations""",
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut out of a code fence or from behind the word assistant."""
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n``` and talk"))
    said = F.concat(F.lit("prompt Assistant "), F.col("role"))
    answer = F.when(F.col("turn") % 2 == 0, X.unfenced(fenced)).otherwise(X.after_assistant(said))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


@register(
    "catalogue_lines",
    r"""WITH p AS (SELECT page_id, string_split(replace(replace(html, '><', '>' || chr(10) || ' <'), '<b', 'Ref. Code Ø ' || page_id || '.5 ~ 7 <b'), chr(10)) AS l FROM pages)
    SELECT page_id, CAST(i AS INTEGER) AS line_idx, trim(l[i + 1], ' ' || chr(9) || chr(13)) AS line FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM p)
      WHERE regexp_matches(l[i + 1], '(?i)ref\.?\s*code') OR regexp_matches(l[i + 1], 'Ø\s*\d+(\.\d+)?\s*~\s*\d+(\.\d+)?')""",
)
def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.replace("html", F.lit("><"), F.lit(">\n <"))
    marked = F.replace(page, F.lit("<b"), F.concat(F.lit("Ref. Code Ø "), F.col("page_id").cast("string"), F.lit(".5 ~ 7 <b")))
    return text_source.catalogue_lines(table(spark, sf_dir, "pages").select("page_id", marked.alias("text")), ["page_id"])


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with descriptions in all the forms that the extraction knows."""
    code = F.concat(F.upper(F.substring("p_name", 1, 3)), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Наименование и обозначение: Сверло "), "p_name", F.lit(" "), code, F.lit(" 5 шт")))
        .when(kind == 1, F.concat(F.lit("Наименование: Фреза "), "p_name", F.lit(" | Производитель: "), "p_brand", F.lit(" | Количество: 5")))
        .when(kind == 2, F.concat(F.lit("Цанга ER"), F.col("p_size").cast("string"), F.lit(" ø 40 мм Фирма: "), F.col("p_type")))
        .when(kind == 3, F.concat(F.lit("Товары работы услуги: Патрон Sandvik "), code, F.lit(" HSK-A63 Ø 12,5 x 30 \nКол.: 7")))
        .when(kind == 4, F.concat(F.col("p_name"), F.lit(" LОБЩ = 80 мм (с покрытием) Код заказа: "), F.col("p_partkey").cast("string"), F.lit(" Срок поставки: 5 дней К оплате")))
        .otherwise(F.concat(F.lit("Бренд: "), F.upper("p_name"), F.lit(" угол 90°")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", code.alias("code"), kind.alias("kind"), text.alias("text"))


_DESCRIBED = """
d AS (
  SELECT *, upper(p_name[1:3]) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS code, p_partkey % 6 AS kind,
    CASE p_partkey % 6 WHEN 0 THEN 'Наименование и обозначение: Сверло ' || p_name || ' ' || upper(p_name[1:3]) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || ' 5 шт'
      WHEN 1 THEN 'Наименование: Фреза ' || p_name || ' | Производитель: ' || p_brand || ' | Количество: 5'
      WHEN 2 THEN 'Цанга ER' || p_size || ' ø 40 мм Фирма: ' || p_type
      WHEN 3 THEN 'Товары работы услуги: Патрон Sandvik ' || upper(p_name[1:3]) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || ' HSK-A63 Ø 12,5 x 30 ' || chr(10) || 'Кол.: 7'
      WHEN 4 THEN p_name || ' LОБЩ = 80 мм (с покрытием) Код заказа: ' || p_partkey || ' Срок поставки: 5 дней К оплате'
      ELSE 'Бренд: ' || upper(p_name) || ' угол 90°' END AS text
  FROM part
)"""


_ALL = " || ".join(f"regexp_extract_all(text, '{p}')" for p in E.CODES)
_PLUS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in E.FREE_CODES)


@register(
    "denotation",
    f"""WITH {_DESCRIBED}, c AS (SELECT p_partkey, {_ALL} AS l, {_PLUS} AS f FROM d),
    u AS (SELECT p_partkey, l[i] AS v, min(i) AS place FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM c) GROUP BY ALL),
    j AS (SELECT p_partkey, string_agg(v, ' ' ORDER BY place) AS codes FROM u GROUP BY p_partkey)
    SELECT c.p_partkey, coalesce(codes, '') AS codes, list_filter(f, lambda x: length(x) = list_max(list_transform(f, lambda y: length(y))))[1] AS longest
    FROM c LEFT JOIN j ON c.p_partkey = j.p_partkey""",
)
def denotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("p_partkey", E.codes(F.col("text")).alias("codes"), E.longest_code(F.col("text")).alias("longest"))


@register(
    "reasoning_text",
    """SELECT p_partkey, '1. ' || p_name || ' (' || p_brand || ', ' || p_type || ')' || chr(10) || '2. ' || p_type || chr(10) || '7. last (' || p_size || ')' AS text, 3 AS steps,
      round(((p_size % 11) / 10.0 + 0.75 + 0.5) / 3, 9)::DOUBLE AS mean, CAST(1 + CASE WHEN p_size % 11 > 7 THEN 1 ELSE 0 END AS INTEGER) AS high, CAST(CASE WHEN p_size % 11 < 5 THEN 1 ELSE 0 END AS INTEGER) AS low FROM part""",
)
def reasoning_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as text, and their summary."""
    none = F.array().cast("array<string>")
    steps = F.array(
        E.step(1, F.col("p_name"), (F.col("p_size") % 11) / 10, F.array("p_brand", "p_type")), E.step(2, F.col("p_type"), F.lit(0.75), none), E.step(7, F.lit("last"), F.lit(0.5), F.array(F.col("p_size").cast("string")))
    )
    told = table(spark, sf_dir, "part").withColumn("s", steps).select("p_partkey", E.reasoning_text(F.col("s")).alias("text"), E.reasoning_summary(F.col("s")).alias("m"))
    return told.select("p_partkey", "text", "m.steps", F.round("m.mean", 9).alias("mean"), "m.high", "m.low")


@register(
    "maker_rules",
    f"""WITH {_DESCRIBED} SELECT p_partkey, CASE WHEN contains(u, 'SDJCR') OR contains(u, 'CNMG') THEN 'Sandvik' WHEN contains(u, 'YG') OR contains(u, 'DH') OR contains(u, 'DJ') THEN 'YG-1'
      WHEN contains(u, 'KGM') THEN 'KELITE' WHEN contains(u, 'DCMT') THEN 'ZCC' WHEN contains(u, 'ER') THEN 'EROGLU' WHEN contains(u, 'HSK') OR contains(u, 'BT') THEN 'DAndrea'
      WHEN contains(u, 'A0') OR contains(u, 'A1') THEN 'JieHe' ELSE 'Неизвестно' END AS maker,
      CASE WHEN contains(lower(text), 'сверло') THEN 'Сверло' WHEN contains(lower(text), 'фреза') THEN 'Фреза' WHEN contains(lower(text), 'цанга') THEN 'Цанга' ELSE 'Неизвестно' END AS kind,
      CAST(least(0.5 + CASE WHEN starts_with(lower(text), 'цанга') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), 'сверло') OR contains(lower(text), 'фреза') THEN 0.1 ELSE 0 END, 1) AS DOUBLE) AS confidence
    FROM (SELECT *, upper(text) AS u FROM d)""",
)
def maker_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _described(spark, sf_dir).select("p_partkey", E.maker_by_code(t).alias("maker"), E.type_by_words(t).alias("kind"), F.round(E.type_confidence(t, F.lit("Цанга")), 6).alias("confidence"))


@register(
    "relevant_entities",
    f"""WITH {_DESCRIBED} SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(text), 'lобщ') THEN 'Lобщ' END, CASE WHEN contains(lower(text), 'hsk') THEN 'HSK' END,
        CASE WHEN contains(lower(text), 'er') THEN 'ER' END, CASE WHEN contains(lower(text), 'угол') THEN 'угол' END,
        CASE WHEN contains(lower(text), 'сверло') THEN 'сверло→Сверло' END, CASE WHEN contains(lower(text), 'фреза') THEN 'фреза→Фреза' END], lambda x: x IS NOT NULL), ',') AS entities FROM d""",
)
def relevant_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"Сверло": ["сверло", "drill"], "Фреза": ["фреза", "mill"]}
    found = E.relevant_entities(F.col("text"), ["Lобщ", "HSK", "ER", "угол"], words)
    return _described(spark, sf_dir).select("p_partkey", F.array_join(found, ",").alias("entities"))
