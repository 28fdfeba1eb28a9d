"""Secrets in texts: fixed patterns, and strings that look random to a pair of character Markov models.

One model is trained on random strings, one on ordinary identifiers. A string of key-like characters is a secret if its
mean log-likelihood ratio for each character is above a threshold. Training, scanning and scoring are DataFrame
functions: the models are one array of ratios for each pair of successive characters, folded into the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import ROW, carried, released, whole_text

# Fixed patterns of the base kinds. The last two hold their least length, which changes no match: a shorter run of the
# same characters cannot hide a longer one.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

#: A string that the models judge: key-like characters with a digit and a letter among them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 1.2  #: mean log-likelihood ratio above which a string is random: chosen between the random strings (1.8 or more) and names (0.7 or less) of the test
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Fixed lists of words of which ordinary identifiers and compounds are made (labelled samples): of programs, and of texts
# in English, German, French and Spanish without their accents.
CODE = [
    "get", "set", "is", "has", "to", "from", "user", "name", "index", "count", "value", "list", "item", "data", "file", "path", "size", "type", "key", "map",
    "node", "tree", "row", "column", "table", "field", "text", "line", "page", "host", "port", "code", "error", "message", "request", "response", "client",
    "server", "config", "option", "default", "input", "output", "buffer", "stream", "start", "end", "next", "previous", "min", "max", "time", "date", "year",
    "create", "update", "delete", "select", "where", "order", "group", "join", "left", "right", "width", "height", "image", "button", "label", "header",
    "parent", "child", "test", "model", "view", "controller", "service", "manager", "handler", "factory", "builder", "parser", "version", "build", "number",
]
ENGLISH = [
    "house", "water", "people", "through", "world", "school", "country", "between", "thought", "night", "children", "government", "company", "system",
    "question", "business", "research", "development", "information", "international", "knowledge", "university", "community", "experience", "political",
    "weather", "morning", "kingdom", "freshly", "strength", "blackbird", "overview", "network", "language", "together", "exchange", "highway", "judgement",
]
GERMAN = [
    "schiff", "fahrt", "gesellschaft", "dampf", "donau", "versicherung", "arbeit", "geschichte", "zeitung", "krankenhaus", "bundes", "regierung", "schule",
    "wissenschaft", "entwicklung", "strasse", "bahnhof", "freund", "zwischen", "jahrhundert", "sprache", "wirtschaft", "stadt", "landschaft", "haupt",
    "verkehr", "gemeinde", "rechts", "anwalt", "pflicht", "kraft", "werk", "grund", "gesetz", "lehrer", "buch", "handlung", "herbst", "quelle", "jungfrau",
]
FRENCH = [
    "maison", "travail", "histoire", "gouvernement", "politique", "question", "heureux", "beaucoup", "toujours", "enfant", "aujourdhui", "developpement",
    "entreprise", "environnement", "quelque", "pourquoi", "lumiere", "chambre", "premiere", "monsieur", "voyage", "pouvoir", "jeunesse", "republique",
    "anticonstitutionnellement", "naturellement", "bibliotheque", "francaise", "systeme", "eau", "oiseau", "feuille", "vieux", "douze", "chaque",
]
SPANISH = [
    "trabajo", "gobierno", "historia", "desarrollo", "empresa", "ciudad", "pueblo", "siempre", "familia", "escuela", "corazon", "palabra", "pregunta",
    "informacion", "conocimiento", "universidad", "internacional", "izquierda", "derecha", "mujer", "hombre", "guerra", "noche", "llamada", "quizas",
    "ayuntamiento", "ferrocarril", "lluvia", "jardin", "juventud", "zapato", "queso", "viaje", "carretera", "calle", "naturaleza", "sencillo", "mejor",
]
#: Rows of characters that people type in order.
ROWS = ["abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "01234567890123456789", "98765432109876543210", "qwertyuiopasdfghjklzxcvbnm", "qwertzuiopasdfghjklyxcvbnm", "azertyuiopqsdfghjklmwxcvbn"]


def default_samples(spark: SparkSession, strings: int = 1500) -> DataFrame:
    """Labelled samples (text, is_random): random base-64, alphanumeric, upper-case and hexadecimal strings from hashes of
    numbers; identifiers of two to four words of a language in the usual spellings, compounds of such words, both partly
    with a short number; dates, rows of characters in order, and one character repeated."""
    n = spark.range(strings)
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.translate(coded, "+/=", "")
    hexes = F.substring(F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256), 1, 40)
    randoms = n.select(F.explode(F.array(coded, plain, F.translate(coded, "+/=", "-_"), F.upper(plain), hexes)).alias("text"), F.lit(True).alias("is_random"))
    languages = F.array(*(F.array(*map(F.lit, words)) for words in (CODE, CODE, ENGLISH, GERMAN, FRENCH, SPANISH)))
    hashed = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most) if isinstance(most, int) else most).cast("int")
    own = F.element_at(languages, hashed(10, 6) + 1)
    drawn = n.select("id", own.alias("words"))
    pick = lambda salt: F.element_at("words", hashed(salt, F.size("words")) + 1)
    parts = F.slice(F.array(*map(pick, range(4))), 1, hashed(9, 3) + 2)
    named = drawn.select("id", parts.alias("parts"), F.when(hashed(8, 2) == 0, hashed(7, 2030).cast("string")).otherwise("").alias("number"))
    title = F.transform("parts", F.initcap)
    joined = [F.array_join("parts", "_"), F.array_join("parts", "-"), F.array_join("parts", "/"), F.array_join(title, ""), F.upper(F.array_join("parts", "_")), F.array_join("parts", ""), F.initcap(F.array_join("parts", ""))]
    names = named.select(F.explode(F.array(*(F.concat(x, "number") for x in joined))).alias("text"), F.lit(False).alias("is_random"))
    rows = [*ROWS, *map(str.upper, ROWS), *(c * 24 for c in ALPHABET)]
    stamp = F.date_format(F.timestamp_seconds(F.col("id") * 7_654_321), "yyyy-MM-dd'T'HH-mm-ss")
    typed = spark.range(max(1, strings // 10)).select(F.explode(F.array(stamp, *map(F.lit, rows))).alias("text"), F.lit(False).alias("is_random"))
    return randoms.unionByName(names).unionByName(typed)


def train(samples: DataFrame, *, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of successive characters of ALPHABET, row by row, then of pairs with any other.

    Null or one-character samples count for nothing. The counts are at most two for each pair: their number is fixed.
    """
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.expr("transform(sequence(1, size(codes) - 1), i -> struct(codes[i - 1] as a, codes[i] as b))")
    rows = samples.where((F.length("text") > 1) & F.col("is_random").isNotNull()).select("is_random", codes.alias("codes")).select("is_random", F.explode(pairs).alias("p")).where("p.a >= 0 and p.b >= 0")
    found = {(r[0], r[1], r[2]): r[3] for r in rows.groupBy("is_random", "p.a", "p.b").count().collect()}
    n = len(ALPHABET)
    ratios = []
    for a in range(n):
        total = {y: sum(found.get((y, a, b), 0) for b in range(n)) + smoothing * n for y in (True, False)}
        ratios += [math.log((found.get((True, a, b), 0) + smoothing) / total[True]) - math.log((found.get((False, a, b), 0) + smoothing) / total[False]) for b in range(n)]
    return ratios


def randomness(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio for each pair of characters of a string over ALPHABET."""
    table = F.expr(f"cast(split('{','.join(f'{r:.4f}' for r in ratios)}', ',') as array<double>)")
    letters = F.lit(ALPHABET)
    at = lambda i: F.instr(letters, F.substring(text, i, 1)) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(text) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, at(i) * len(ALPHABET) + at(i + 1) + 1))
    return total / (F.length(text) - 1)


def scan(rows: DataFrame, ratios: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """`rows` (text, not null), with `base` and `spans` (arrays of spans by start, then kind).

    Spans of the models that base spans hold wholly, but for the "x" or "0x" of a hexadecimal number, are left out; others
    stand beside the base spans that they touch. Texts of any length are scanned whole; repeated rows give a row each; an
    empty table gives an empty result.
    """
    text = F.col("text")
    group2 = lambda hit: F.regexp_extract(hit, r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    assign = F.filter(spans.find(text, ASSIGN, 0), lambda s: F.length(group2(s["hit"])) >= 6)
    found = rows.withColumn("base", spans.together(assign, spans.find(text, ACCESS, 1), spans.find(text, HEX, 2)))
    wide = F.filter(spans.find(text, CANDIDATE, 3), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]") & (randomness(s["hit"], ratios) > threshold))
    begin = lambda s: s["start"] + F.length(F.regexp_extract(s["hit"], rf"^0?x(?={HEX})", 0))
    held = lambda s: F.aggregate(F.col("base"), begin(s), lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["stop"])).otherwise(at))
    extra = F.filter(wide, lambda s: held(s) < s["stop"])
    return found.withColumn("spans", spans.together(F.col("base"), extra))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of `docs` (doc_id, text).

    Null and empty texts have no spans; null doc_ids and repeated rows give a row each; other columns are not read; an
    empty table gives an empty result.
    """
    ratios = train(default_samples(docs.sparkSession) if samples is None else samples)
    found = scan(docs.select("doc_id", whole_text().alias("text")), ratios, threshold=threshold)
    return found.select(
        "doc_id",
        *(spans.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(spans.written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.written(F.col("spans"), KINDS).alias("spans"),
    )


def mask_secrets(docs: DataFrame, samples: DataFrame | None = None, *, threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """The rows and columns of `docs` with every secret in `text` replaced by `mask`; other rows are unchanged, null text too.

    `n_chars`, if there is such a column, is counted anew for changed texts; columns of any other names keep their values.
    """
    ratios = train(default_samples(docs.sparkSession) if samples is None else samples)
    found = scan(carried(docs).withColumn("text", whole_text(f"{ROW}.text")), ratios, threshold=threshold)
    hit = F.size("spans") > 0
    changed = {"text": F.when(hit, spans.masked(F.col("text"), F.col("spans"), mask)).otherwise(F.col(f"{ROW}.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"{ROW}.n_chars"))
    return released(found, **changed)
