"""The filter audit, the token counts and the vector codes against plain versions."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from docloom.llm import classifier, common, filter_audit, multiset, queries, token_counts, vector_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, n long, mask int, part string, n_bytes long"


def texts():
    long = " ".join(f"word{i}" for i in range(150))
    again = " ".join(["same words again"] * 60)
    return [long, long, again, "SHOUT " * 120, long + " 50% & more", "", None, "a b\x0bc\x0cd\x1ce", long.upper(), again, "é" * 40 + " ÀÉ Z", long, "tail\n" * 3]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "de", None, ""]
    rows = [(i, t, langs[i % 4], 7, 3, "x", 1) for i, t in enumerate(texts())]
    rows += [rows[1], (None, texts()[0], "en", 1, 1, "y", 2), (None, None, None, None, None, None, None), (40, texts()[0], "fr", 1, 1, "z", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def plain_fails(text):
    words = WORD.findall(text)
    return [
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))
    ]


def plain_audit(rows, labels):
    """The report by filtering documents, one order after the other."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    found = []
    for r in rows:
        text = r.text or ""
        copy = r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in rows)
        found.append((r.lang or "", r.doc_id in good, r.doc_id in toxic, [*plain_fails(text), copy]))
    out = {}
    for part in {f[0] for f in found}:
        own, shapley = [f for f in found if f[0] == part], defaultdict(int)
        for order in itertools.permutations(range(5)):
            left = own
            for k, f in enumerate(order):
                failing = [d for d in own if d[3][f]]
                gone = [d for d in left if d[3][f]]
                left = [d for d in left if not d[3][f]]
                shapley[f] += len(gone)
                alone = sum(sum(d[3]) == 1 for d in failing)
                name = "".join("ABCDE"[x] for x in order)
                out[part, name, k + 1] = (len(left), len(gone), len(failing) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key], shapley["ABCDE".index(key[1][key[2] - 1])])
    return out


def as_report(frame):
    rows = frame.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_swaps_visit_every_order():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_walk_counts_only_swapped_steps(monkeypatch):
    counts = np.arange(96).reshape(32, 3)
    asked = []
    step = filter_audit.Cells.step
    monkeypatch.setattr(filter_audit.Cells, "step", lambda self, before, bit: asked.append(1) or step(self, before, bit))
    assert len(list(filter_audit.walk(counts))) == 120 and len(asked) == 5 + 2 * 119


def test_audit(spark, docs, labels):
    found = as_report(filter_audit.audit(docs, labels))
    assert found == plain_audit(docs.collect(), labels.collect())
    assert len(found) == 600 * len({part for part, _, _ in found})
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {v[4:6] for v in as_report(filter_audit.audit(docs, labels.limit(0))).values()} == {(0, 0)}


def test_audit_of_one_text_many_times(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) as text", "'en' as lang")
    found = as_report(filter_audit.audit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found["en", "EABCD", 1] == (4001, 1999, 0, 0, 0, 0, found["en", "EABCD", 1][6])


def test_audit_sql(spark):
    ours = as_report(queries.QUERIES["op11_filter_audit"](spark, SF))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL["op11_filter_audit"]).fetchall()
    names = [d[0] for d in con.execute(queries.ORACLE_SQL["op11_filter_audit"]).description]
    assert names == [c.split()[0] for c in filter_audit.REPORT.split(", ")]
    assert {r[:3]: r[3:] for r in theirs} == ours


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def odd_texts():
    made = random.Random(5)
    letters = "ab Ä̈éß İıΣς 1٣½²'s're n't.,!?#<|endoftext|><|startoftext|>\n\t\x0b\x0c\x1c\x1f\x85\xa0 ​　漢字한글😀👩‍👩‍👧\u0000�"
    runs = ["<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|endoftext|", "it's IT'S", "̈a", "a ̈", "x" * 5000, "ab" * 200 + " " + "ab" * 200, "각", "ﬁ Å Å"]
    return [*runs, *("".join(made.choice(letters) for _ in range(made.randint(1, 60))) for _ in range(3000))]


def test_token_counts(spark, docs, tokenizer):
    path, plain = tokenizer
    rows = [(i, t) for i, t in enumerate([*texts(), *odd_texts()])]
    rows += [rows[0], (None, "no key"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for frequent in (200_000, 50, 1):  # all pre-tokens sent to the tasks, some, none
        got = token_counts.count_tokens(table, path, limit=100, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(table.limit(0), path).count() == 0
    assert token_counts.count_tokens(docs, path).count() == docs.count()


def test_token_counts_of_the_table(spark, tokenizer):
    path, plain = tokenizer
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op12_token_counts"](spark, SF).collect()}
    for r, found in zip(rows, plain.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        assert got[r.doc_id] == (len((r.text or "").encode()), len(found.ids), len(found.ids) > 2048)


def test_each_pre_token_is_cut_once(spark, tokenizer):
    table = spark.createDataFrame([("b a a",), ("a c c",), (None,)], "text string").selectExpr("cast(text as binary) as text").repartition(3)
    counted = token_counts.frequencies(table, tokenizer[0]).collect()
    assert sorted((r.pre_token, r.n) for r in counted) == [("a", 3), ("b", 1), ("c", 2)]


def plain_codes(rows, parts, entries, rounds):
    """Plain Lloyd in Python integers: codes, errors and codebooks by row."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    d = len(kept[0][1]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * d : p * d + d] for r in start] for p in range(parts)]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (distance(x, book[j]), j))
    for n in range(rounds + 1):
        codes = [[near(r[1][p * d : p * d + d], books[p]) for p in range(parts)] for r in kept]
        if n == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [r[1][p * d : p * d + d] for r, code in zip(kept, codes, strict=True) if code[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(distance(r[1][p * d : p * d + d], books[p][code[p]]) for p in range(parts)) for r, code in zip(kept, codes, strict=True)]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[2]]) for r, code, e in zip(kept, codes, errors, strict=True)], digest


def as_codes(frame):
    rows = frame.collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in rows), {r.codebooks_sha256 for r in rows}


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, n int"


@pytest.mark.parametrize("spread", [0.004, 0.03, 1.0, 300.0])
def test_codes(spark, spread):
    made = random.Random(int(spread * 1000))
    rows = [(i, [made.gauss(0, 1) * spread for _ in range(12)], made.choice([None, 1, 2])) for i in made.sample(range(900), 400)]
    rows += [(i + 1000, rows[i][1], 3) for i in range(30)] + [rows[5], (None, rows[7][1], None), (2000, None, 1), (2001, [], 1)]
    rows += [(2002, [float("nan")] * 12, 1), (2003, [float("inf"), *[0.0] * 11], None), (2004, [None, *[0.0] * 11], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    table = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], VECTORS).repartition(5)
    for entries, rounds in ((64, 2), (7, 3)):
        want, digest = plain_codes(rows, 4, entries, rounds)
        got, digests = as_codes(vector_codes.encode(table, parts=4, entries=entries, rounds=rounds))
        assert digests == {digest}
        assert got == sorted((str(a), *b) for a, *b in want)


def test_codes_of_few_vectors(spark):
    table = spark.createDataFrame([(i, [0.5, -0.25], None, "", 0, 0) for i in range(3)], VECTORS)
    assert as_codes(vector_codes.encode(table, parts=2))[0] == [(str(i), "0000", 0, 0) for i in range(3)]
    assert vector_codes.encode(table.limit(0), parts=2).count() == 0
    assert vector_codes.encode(table.where("vec_id < 0"), parts=2).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vector_codes.encode(table, parts=3)


def test_bounds_spare_distances():
    made = np.random.default_rng(3)
    middles = made.integers(-4000, 4000, (64, 4))
    x = (middles[made.integers(0, 64, 5000)] + made.integers(-60, 60, (5000, 4))).astype(np.int64)
    before = middles + made.integers(-20, 20, (64, 4))
    group = vector_codes.groups_of(before)
    code, upper, lower = vector_codes.Part(before, group).first(x)
    code, _, _, done = vector_codes.Part(middles, group, before).again(x, code, upper, lower)
    assert (code == vector_codes.squared(x, middles).argmin(axis=1)).all()
    assert done < 0.25 * x.shape[0] * 64


def test_codes_sql(spark):
    ours = sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in queries.QUERIES["op13_vector_codes"](spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op13_vector_codes"]).fetchall()) == ours


def test_fingerprints_by_a_plain_sum():
    """Paragraphs one by one, in Python integers: the sum of their vectors modulo 2 ** 32."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def vector(paragraph):
        raw = paragraph.encode()
        out = [int.from_bytes(hashlib.blake2b(raw, digest_size=64).digest()[4 * i : 4 * i + 4], "little") for i in range(16)] + [0] * 224
        words = raw.split()
        h = [xxhash.xxh64_intdigest(w, 7) for w in words]
        steps = [mixed(h[i] * 0x9E3779B97F4A7C15 + h[i + 1] * 0xC2B2AE3D27D4EB4F + h[i + 2] & mask) for i in range(len(h) - 2)]
        if 0 < len(words) < 3:
            steps = [xxhash.xxh64_intdigest(b" ".join(words))]
        for x in steps:
            out[16 + x % 224] += 1 if x >> 63 else -1
        return out

    made = random.Random(4)
    of = multiset.Fingerprinter().of
    for _ in range(200):
        text = "".join(made.choice(["a", "b ", "c\n", " d e f ", "\n\n", "é ", "the quick brown fox\n"]) for _ in range(made.randint(0, 60)))
        total = [0] * 240
        for paragraph in text.split("\n"):
            if paragraph:
                total = [(a + b) % (1 << 32) for a, b in zip(total, vector(paragraph), strict=True)]
        assert of(text).tolist() == total


def test_scores_by_loops():
    """The scorer's sums over words of many texts at once against sums over each text's own rows of the table."""
    settings = classifier.Settings(buckets=1 << 12)
    made = np.random.default_rng(2)
    weight = made.normal(size=settings.buckets)
    words = ["the", "quick", "brown", "été", "x", "12", "fox.", "jumps"]
    texts = [" ".join(made.choice(words, made.integers(0, 40))) for _ in range(60)] + ["", "one", "a b"]
    scorer = classifier.Scorer(weight, 0.3, 0.7, settings)
    for _ in range(2):  # new words, then known ones
        got = scorer.of(texts)
        for text, score in zip(texts, got, strict=True):
            [(rows, counts)] = classifier.text_rows([text], settings)
            want = 1 / (1 + np.exp(-(sum(weight[r] * n for r, n in zip(rows, counts, strict=True)) / max(1, counts.sum()) + 0.3))) if text.split() else 0.7
            assert abs(score - want) < 1e-9


def test_rows_told_apart_by_both_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (1, None), (1, "a")], "doc_id long, text string")
    keys = rows.select(common.row_key(rows.doc_id, rows.text).alias("k"), common.second_key(rows.doc_id, rows.text).alias("s")).collect()
    assert len({(r.k, r.s) for r in keys}) == 4 and len({r.s for r in keys}) == 4 and not {r.k for r in keys} & {r.s for r in keys}
