"""One form for texts that look the same.

Only stretches with characters other than printable ASCII and line feeds can
change. The distinct stretches of all texts are exploded to positioned code
points, a broadcast join maps each to its decomposition with look-alike letters
replaced, blanks unified and invisible characters dropped, marks are ordered by
combining class, clusters are recomposed through a second broadcast join, and
the stretches and texts are put together again. Both tables are derived from
the Unicode character database, so their size is fixed.

Defined cases: a null text stays null and looks like nothing; an empty text
looks like one of invisible characters only; every blank of any width (tabs
included) is a plain space and each counts; CR, CR LF and the Unicode line and
paragraph separators are line feeds; superscripts, subscripts, circled
characters and fractions keep their own look; accents and case count. A mark
with no composed form stays behind its base, in canonical order. Repeated rows
give repeated results; an empty table gives none; further columns are kept,
whatever their names, except that clashing new columns get a longer name.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stewardry.runtime import cut, free_name, join_hot, sha_key

# Letters that are drawn like a Latin letter.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # other
    "օ": "o", "ɡ": "g", "‐": "-", "κ": "k", "υ": "u", "ι": "i", "ɑ": "a", "ı": "i", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "⁄": "/", "∕": "/",
    # Armenian
    "Տ": "S", "Օ": "O", "Լ": "L", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X",
    "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

#: Kinds of compatibility decompositions that keep the look.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_LINE_ENDS = {"\r", "\x85", " ", " "}
_DRAWN_BLANK, _LONG_S = " ", "ſ"
_DRAWN_FORMATS = {*map(chr, range(0x600, 0x606)), "۝", "܏", "࢐", "࢑", "࣢", "\U000110bd", "\U000110cd"}

#: A stretch: at most a base character, 48 others and what attaches to them, so that it is short and never cuts a cluster.
STRETCH = r"[!-~]?[^ -~\n]{1,48}[\p{M}\p{Cf}ᅠ-ᇿ]*"


def _parts(c: str) -> str:
    """What a character is drawn as, fully decomposed."""
    if c in _LINE_ENDS:
        return "\n"
    kind = unicodedata.category(c)
    if c == "\t" or kind == "Zs" and c != _DRAWN_BLANK:
        return " "
    if kind == "Cf" and c not in _DRAWN_FORMATS or c == "͏" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    tag, _, rest = unicodedata.decomposition(c).rpartition("> ")
    codes = [chr(int(x, 16)) for x in rest.split()]
    if tag and (f"{tag}>" not in _SAME_LOOK or codes[0] == " " or c == _LONG_S):
        codes = []
    if not codes:
        codes = list(unicodedata.normalize("NFD", c))  # Hangul syllables have no listed decomposition
        return "".join(LOOK_ALIKES.get(x, x) for x in codes)
    return "".join(map(_parts, codes))


@functools.cache
def _tables() -> tuple[list, list]:
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    mapped, composed = [], []
    for c in every:
        if c.isascii() and c not in "\t\r":
            continue
        parts = _parts(c)
        if parts != c or unicodedata.combining(c) or "ᅠ" <= c <= "ᇿ":
            mapped.append((c, [(p, unicodedata.combining(p), not unicodedata.combining(p) and not "ᅠ" <= p <= "ᇿ") for p in parts]))
        canonical = unicodedata.normalize("NFD", c)
        if canonical != c and unicodedata.normalize("NFC", c) == c:
            key = "".join(LOOK_ALIKES.get(x, x) for x in canonical)
            if key == canonical:  # what has a Latin look-alike is composed as Latin
                composed.append((key, c))
    return mapped, composed


@functools.cache
def _pairs() -> str:
    """What composes with what, as JSON: a base, composed or not, and a mark."""
    pairs = {}
    for i in range(0x110000):
        parts = unicodedata.decomposition(chr(i))
        if parts and not parts.startswith("<") and " " in parts and unicodedata.normalize("NFC", chr(i)) == chr(i):
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            if not any(x in LOOK_ALIKES for x in pair) and unicodedata.combining(pair[-1]):
                pairs[pair] = chr(i)
    return json.dumps(pairs)


def _composed(marks: Column) -> Column:
    """A cluster with each mark composed that nothing between it and its base blocks; ``marks`` are in canonical order, the base first."""
    pairs = F.from_json(F.lit(_pairs()), "map<string,string>")
    first = F.element_at(marks, 1)
    start = F.struct(first["part"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(done: Column, x: Column) -> Column:
        made = F.element_at(pairs, F.concat(done["base"], x["part"]))
        free = (done["rest"] == "") | (done["last"] < x["class"])
        joined = F.struct(made.alias("base"), done["rest"].alias("rest"), done["last"].alias("last"))
        kept = F.struct(done["base"].alias("base"), F.concat(done["rest"], x["part"]).alias("rest"), x["class"].alias("last"))
        return F.when(free & made.isNotNull(), joined).otherwise(kept)

    return F.aggregate(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), start, step, lambda done: F.concat(done["base"], done["rest"]))


def _stretches(text: str):
    return F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0))


def _normal_forms(spark: SparkSession, stretches: DataFrame) -> DataFrame:
    """(stretch, n, form) of distinct stretches; all steps stay within the partitioning by stretch."""
    mapped, composed = _tables()
    mapping = spark.createDataFrame(mapped, "char string, parts array<struct<part:string,class:int,starts:boolean>>")
    compositions = spark.createDataFrame(composed, "cluster string, one string")
    itself = F.array(F.struct(F.col("char").alias("part"), F.lit(0).alias("class"), F.lit(True).alias("starts")))
    points = stretches.select("stretch", "n", F.posexplode(F.split("stretch", "")).alias("at", "char")).where(F.col("char") != "")
    points = points.join(F.broadcast(mapping), "char", "left")  # fixed size: Unicode's
    points = points.select("stretch", "n", "at", F.posexplode(F.coalesce("parts", itself)).alias("sub", "p")).select("stretch", "n", "at", "sub", "p.*")
    order = Window.partitionBy("stretch").orderBy("at", "sub")
    points = points.withColumn("cluster_no", F.sum(F.col("starts").cast("int")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("class", "at", "sub", "part")))
    clusters = points.groupBy("stretch", "cluster_no").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("cluster"), ordered.alias("marks"))
    clusters = clusters.join(F.broadcast(compositions), "cluster", "left")  # fixed size: Unicode's
    pieces = F.array_sort(F.collect_list(F.struct("cluster_no", F.coalesce("one", F.when(F.size("marks") > 2, _composed(F.col("marks"))).otherwise(F.col("cluster"))).alias("text"))))
    forms = clusters.groupBy("stretch").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("form"))
    # a stretch of invisible characters only has no points left
    return stretches.join(forms, "stretch", "left").select("stretch", "n", F.coalesce("form", F.lit("")).alias("form"))


def normalise(df: DataFrame, text: str = "text", out: str = "look") -> DataFrame:
    """Adds the text's one form as column ``out``."""
    spark = df.sparkSession
    out = free_name(df, out)
    key, plain, parts, k = (free_name(df, x) for x in ("text_key", "plain", "parts", "k"))
    base = df.withColumn(plain, F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")))
    strange = F.coalesce(F.col(plain).rlike(r"[^ -~\n]"), F.lit(False))
    odd = base.where(strange).withColumn(key, sha_key(plain))
    uses = odd.select(F.col(key).alias("k"), F.posexplode(_stretches(plain)).alias("at", "stretch"))
    forms = cut(_normal_forms(spark, uses.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))))
    rebuilt = join_hot(uses, forms, ["stretch"], "n").groupBy(F.col("k").alias(k)).agg(F.array_sort(F.collect_set(F.struct("at", "form"))).alias(parts))
    known = odd.join(rebuilt, F.col(key) == F.col(k))
    between = F.split(F.col(plain), STRETCH, -1)
    joined = F.zip_with(between, F.array_append(F.transform(parts, lambda x: x["form"]), F.lit("")), lambda a, b: F.concat(a, b))
    changed = known.select(*df.columns, F.array_join(joined, "").alias(out))
    return base.where(~strange).select(*df.columns, F.col(plain).alias(out)).unionByName(changed)


def _looks(df: DataFrame, identifier: str, text: str) -> DataFrame:
    """(id, string_key, look_key) of all rows with a text."""
    base = df.select(F.col(identifier).alias("id"), F.col(text).alias("text"))
    return normalise(base, "text", "look").where(F.col("look").isNotNull()).select("id", sha_key("text").alias("string_key"), sha_key("look").alias("look_key"))


def same_look_pairs(df: DataFrame, identifier: str, text: str = "text") -> DataFrame:
    """(id_a, id_b), a < b, of rows whose texts look the same without being the same string.

    Distinct strings of a look are paired, not rows, and looks of one string only,
    such as a third of all rows being blank, pair nothing; what comes out is then
    the only thing that can grow faster than the rows. ``look_classes`` does not grow so.
    """
    looks = cut(_looks(df, identifier, text))
    strings = looks.groupBy("look_key", "string_key").agg(F.count(F.lit(1)).alias("n"))
    a, b = strings.select("look_key", F.col("string_key").alias("a")), strings.select("look_key", F.col("string_key").alias("b"))
    pairs = cut(a.join(b, "look_key").where(F.col("a") < F.col("b")).select("a", "b"))
    left = looks.select(F.col("string_key").alias("a"), F.col("id").alias("id_1"))
    right = looks.select(F.col("string_key").alias("b"), F.col("id").alias("id_2"))
    rows = pairs.join(left, "a").join(right, "b").where(F.col("id_1") != F.col("id_2"))
    return rows.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))


def look_classes(df: DataFrame, identifier: str, text: str = "text") -> DataFrame:
    """(id, representative, n_rows, n_strings): a row per text, with the least id that looks the same, and how many rows and strings do."""
    looks = cut(_looks(df, identifier, text))
    strings = looks.groupBy("look_key", "string_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = strings.groupBy("look_key").agg(F.min("least").alias("representative"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_strings"))
    return join_hot(looks.select("id", "look_key"), classes.withColumn("heat", F.col("n_rows")), ["look_key"], "heat").select("id", "representative", "n_rows", "n_strings")
