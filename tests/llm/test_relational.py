"""Chat formatting, line dedup and mixing: edge cases and exact expectations."""

import hashlib

from pyspark.sql import functions as F

from framequery.llm import chat, line_dedup, mixing


def _chat(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.withColumn("turns", F.lit(1)).withColumn("segments", F.lit("x")).withColumn("formatted", F.lit(0))
    out = chat.format_conversations(df)
    return {
        r["conv_id"]: r
        for r in out.select("conv_id", "formatted", "n_messages", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).collect()
    }


def test_chat_round_trip_with_control_strings(spark):
    nasty = ["<turn:user>", "</turn>", "<part>", "\\s\\l", "\\", "<", ">", "a\nb", "", None, "é\U0001f600", "\\### Assistant: </turn> ok"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(nasty)] + [(None, 0, None, None), (3, None, "<r>\\", "x"), (3, 0, "assistant", "y")]
    got = _chat(spark, rows, extra=True)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(nasty) if i % 3)
    assert got[1]["joined"] == got[1]["formatted"]
    assert got[1]["n_messages"] == 8  # a user turn, then two assistant turns that are merged, four times
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("<r>\\", "x"), ("assistant", "y")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]


def test_chat_ties_and_repeats_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    a, b = _chat(spark, rows)[1], _chat(spark, rows[::-1])[1]
    assert a["formatted"] == b["formatted"]
    assert [t["text"] for t in a["turns"]] == ["z", "a", "a", "b"]


def test_chat_empty_and_long(spark):
    assert _chat(spark, []) == {}
    long = [(1, i, "assistant", "x<" * 50) for i in range(3000)]
    got = _chat(spark, long)[1]
    assert len(got["turns"]) == 3000 and got["n_messages"] == 1
    assert hashlib.sha256(got["loss"].encode()).digest() == hashlib.sha256(("x<" * 50 * 3000).encode()).digest()


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_kept", F.lit(1)).withColumn("h1", F.lit(2))


def _dedup_plainly(rows, least, keep_first=True):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "\0").split("\n"):
            key = line.strip(" ")
            if t is not None and key:
                sites.setdefault(key, set()).add(s)
                first[key] = min(first.get(key, i), i)
    gone = lambda key, i: len(sites.get(key, ())) >= least and not (keep_first and first[key] == i)
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(x.strip(" "), i))) for i, t, s in rows)


ROWS = [(i, f"own {i}\n  shared {i % 3} \nall\n{'twice' if i < 2 else i}\n", f"s{i % 7}") for i in range(40)] + [(40, None, "s1"), (41, "", "s2"), (42, "all", None), (43, "all\nall", None), (42, "all", None)]


def test_line_dedup_matches_a_plain_version(spark, monkeypatch):
    for least in (2, 5, 8):
        for keep in (True, False):
            out = line_dedup.remove_boilerplate(_docs(spark, ROWS), min_sites=least, keep_first=keep)
            got = sorted((r["doc_id"], r["text"]) for r in out.collect())
            assert sorted(got, key=str) == sorted(_dedup_plainly(ROWS, least, keep), key=str)
            assert out.columns == ["doc_id", "text", "source", "_kept", "h1", "n_lines", "n_removed"]
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)  # the join instead of the set
    out = line_dedup.remove_boilerplate(_docs(spark, ROWS), min_sites=5)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(_dedup_plainly(ROWS, 5), key=str)
    assert line_dedup.remove_boilerplate(_docs(spark, []), min_sites=2).count() == 0


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[0 if i % 10 else 1]) for i in range(2000)] + [(9001, None, "c"), (9002, " \t", "c"), (9003, "one", None), (None, "two words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix", F.lit(1))
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r["source"], [r["mix_source_size"], r["mix_target"], 0])[2] += r["mix_size"] * r["mix_copies"]
        assert 0 <= r["mix_copies"] <= 3
    assert per["c"][:2] == [0, 0.0] and per["c"][2] == 0
    assert abs(sum(v[1] for v in per.values()) - sum(v[0] for v in per.values())) < 1e-6
    for size, target, taken in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 0.1 * target + 10
    again = {(r["doc_id"], r["mix_copies"]) for r in mixing.plan(df.orderBy(F.desc("doc_id"))).collect()}
    assert again == {(r["doc_id"], r["mix_copies"]) for r in got}
    assert mixing.mix(df).count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix(df).columns == ["doc_id", "text", "source", "mix", "mix_copy"]
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_weights_follow_code_points(spark):
    sizes = spark.createDataFrame([(s, 10) for s in ["b", "a", "é", "Z", None, "z"]], "source string, source_size long")
    got = {r["source"]: r["weight"] for r in mixing.cyclic_weights(sizes, (5, 2, 1)).collect()}
    assert got == {"Z": 5, "a": 2, "b": 1, "z": 5, "é": 2, None: 1}
