import hashlib
import random
import re

from pyspark.sql import functions as F

from meshframe.llm import chat
from meshframe.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, it in items:
            iw = words(it)
            n = min(window, len(iw))
            grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    names.add(str(i))
        out.append((d, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def test_equals_brute_force(docs_of, spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß", "The", "x1"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    items = [(i, text(r.choice([9, 10, 11, 25, 60]))) for i in range(12)] + [(20, "The w1"), (21, ""), (22, None), (23, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (3, "w2 É ß w4 w5 x1")]
    docs = []
    for i in range(40):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, len(w))
            parts += [" ".join(w[a : a + r.randint(0, 40)]).upper() if r.random() < 0.3 and "é" not in w else " ".join(w[a:]), text(r.randint(0, 9))]
        docs.append((i, " ".join(parts)))
    docs += [(50, None), (51, ""), (52, "-- !!"), (53, "w1 " * 200), (5, docs[6][1]), (None, docs[7][1])]
    got = decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert sorted((tuple(x) for x in rows), key=repr) == brute(docs, items)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_repetitive_items_and_documents(docs_of, spark):
    """Repeats inside items and documents meet once each, not in all pairs of places."""
    r = random.Random(12)
    items = [(1, "w1 " * 4000), (2, "a b c " * 1500), (3, "0 0 0 0 0 0 7 " * 200 + "end"), (4, " ".join(r.choices("xy", k=300))), (4, "p q r s t u v w x y z")]
    docs = [(1, "w1 " * 30_000), (2, "c a b " * 9000 + "w1"), (3, "0 0 0 0 0 0 7 " * 2000), (4, " ".join(r.choices("xy", k=2000))), (None, "w1 " * 30), (None, "q r s t u v w x y z stop"), (5, "0 0 0 0 0 0 0 0 0 0 0")]
    got = decontaminate(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert sorted((tuple(x) for x in rows), key=repr) == brute(docs, items)


def test_many_rows_without_id_and_a_long_text(docs_of, spark):
    r = random.Random(13)
    item = " ".join(f"i{k}" for k in range(30))
    docs = [(None, " ".join(r.choices(["u", "v"], k=20)) + (" " + item if k % 3 == 0 else "")) for k in range(300)] + [(9, " ".join(f"n{k % 5000}" for k in range(200_000)) + " " + item)]
    got = decontaminate(docs_of(docs), spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(docs, [(1, item)])


def test_empty_tables_and_clashing_columns(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(docs_of([(1, "a b", "x", 9)], "doc_id long, text string, n_hit string, item_id int"), none).first()
    assert row["n_hit"] == 0 and row["item_id"] == 9 and row["items"] == []
    assert decontaminate(docs_of([]), none).count() == 0


def read_back(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(table).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    return {r["conv_id"]: r for r in out.collect()}


def test_turns_and_loss_are_read_back(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\", "a\\|b", "<\\|im_sep|>", "<", "|>", "", "x\n\n", "<|im_sep|>", "\\n", "é🙂<|"]
    rows = [(1, i, ("user", "assistant")[i // 2 % 2], t) for i, t in enumerate(hard)]
    rows += [(2, 0, "we\nird\\n|<|role", "a"), (2, 1, None, None), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "user", "first"), (4, 0, "user", "second"), (None, 0, "user", "no id")]
    got = read_back(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [(r, t) for _, _, r, t in rows[: len(hard)]]
    assert got[1]["loss"] == "".join(t for _, _, r, t in rows[: len(hard)] if r == "assistant")
    assert [tuple(t) for t in got[2]["turns"]] == [("we\nird\\n|<|role", "a"), ("", "")]
    assert [t["text"] for t in got[3]["turns"]] == ["a", "a", "b"] and got[3]["loss"] == "aab"
    assert got[3]["formatted"].count("<|im_start|>") == 1
    assert [t["text"] for t in got[4]["turns"]] == ["first", "second"] and len(got[None]["turns"]) == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_digests_of_the_control_conversation(spark):
    from meshframe.llm.queries import op8_chat_formatting

    row = op8_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    t = chat.CONTROL_TEXT
    assert row["n_turns"] == 2 and row["loss_chars"] == len(t)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
