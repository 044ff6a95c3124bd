"""Collocations against a plain version, with filters of any size and tasks that send early, and the defined cases."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framequery.llm import collocations as C


def _plainly(docs, support, most, top, share=80, scale=2_000_000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= support}
    longer = {}
    for (lang, p), a in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                longer[key] = max(longer.get(key, 0), a)
    rows = []
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * longer.get((lang, p), -1) >= share * a:
            score, k = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def _docs(seed, size=300):
    rng = random.Random(seed)
    words = ["Ab", "b", "é", "È", "d e", "\U0001f600", "x" * 70, "'q'", "-"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    docs = [(rng.choice(["en", "fr", None, "und"]), text(rng.randrange(25))) for _ in range(size)]
    return docs + [("en", None), ("en", ""), (None, " .,; "), ("fr", "b Ab é " * 3000)] + [("en", "copy of one text, copy of one text")] * 40


@pytest.mark.parametrize(("buckets", "support"), [(None, 5), (1 << 16, 30), (64, 9), (1, 7)])
def test_equals_the_plain_version(spark, buckets, support):
    docs = _docs(support)
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(6)
    got = C.collocations(df, support=support, top=15, buckets=buckets)
    assert got.dtypes == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    want = _plainly(docs, support, 4, 15)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_other_lengths(spark):
    docs = _docs(11, 80)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, support=6, most=6, top=1000).collect())) == sorted(_plainly(docs, 6, 6, 1000))


def test_tasks_that_send_early(monkeypatch):
    monkeypatch.setattr(C, "HELD_BUCKETS", 50)
    held = C._Buckets(300)
    rng = random.Random(1)
    plain = Counter()
    for _ in range(30):
        some = [rng.randrange(1 << 18) for _ in range(40)] + [7] * 20
        plain.update(some)
        held.add(C.np.array(some, C.np.uint32))
    found = {}
    for number, content in held.blocks():
        n = len(content) // 4
        ids, counts = C.np.frombuffer(content, C.np.uint16, n), C.np.frombuffer(content, C.np.uint16, n, 2 * n)
        found |= {(number << 16) + int(i): int(c) for i, c in zip(ids, counts, strict=True)}
    assert found == {k: min(v, 300) for k, v in plain.items()} and list(held.blocks()) == []


def test_hashes_of_phrases_agree():
    words = C._Texts(C.Words(C.WORD), pa.array(["a B c", None, "c a b c d. e"]), "en")
    for n in (1, 2, 3):
        h = words.hashes(n)
        for i, same in enumerate(words.whole(n)):
            if same:
                phrase = " ".join(words.words[k].decode() for k in words.ids[i : i + n])
                assert int(h[i]) == C.phrase_hash("en", phrase)


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
    rare = spark.createDataFrame([("en", "a b c d")] * 3 + [(None, None)], "lang string, text string")
    assert C.collocations(rare).count() == 0
    # all five parts of the longest phrase are dropped for it
    assert [tuple(r) for r in C.collocations(rare, support=3).collect()] == [("en", 1, "a b c d", 3, 3, 3, 12, 1_000_000)]
    with pytest.raises(ValueError):
        C.collocations(rare, support=0)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["Ab", "b", "é", "c"]) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(5000))
    column = pa.array(["x y", text, "", None, "no end " * 900, "z"])
    monkeypatch.setattr(C, "CHUNK", 700)
    chunks = list(C._chunks(column))
    assert "".join(t or "" for c in chunks for t in c.to_pylist()) == "".join(t or "" for t in column.to_pylist())
    assert len(chunks) > 20 and sum(len(c) == 1 and len(c[0].as_py() or "") > 2000 for c in chunks) == 1  # what has no separator stays whole
    df = spark.createDataFrame([("en", t) for t in column.to_pylist()], "lang string, text string")
    assert sorted(map(tuple, C.collocations(df, support=9, top=50).collect())) == sorted(_plainly([("en", t) for t in column.to_pylist()], 9, 4, 50))
