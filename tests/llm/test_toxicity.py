"""Toxicity grammar against the machines run one after the other, learned words, held-out accuracy, awkward rows."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanlens.llm import toxicity as X
from tests.llm import rows as R


def model(**words):
    own = X.Words([X.folded(" ".join(words))]).word
    return X.Model(own, np.array(list(words.values()), float))


def total(text, m):
    return sum(c[2] for c in m.clauses([X.folded(text)])[1][0])


def test_composed_machine_is_the_machines_in_a_row():
    grammar, machines = X.Grammar(), (X.reported(), X.negated(), X.aimed())
    for size in range(1, 6):
        for symbols in itertools.islice(itertools.product("oIHTNR.", repeat=size), 0, None, 1 if size < 5 else 37):
            states, want, last = [m.start for m in machines], 0.0, 0.0
            weights = [3.0 if s == "I" else 2.0 if s == "H" else 0.0 for s in symbols]
            for symbol, own in zip(symbols, weights):
                last = own or last
                for i, machine in enumerate(machines):
                    states[i], symbol, extra = machine.step(states[i], symbol)
                    want += extra * last
            got = grammar.score([X.Grammar.ALPHABET.index(s) for s in symbols], weights)
            assert abs(got - want) < 1e-9


def test_clauses_weigh_more_than_words():
    m = model(idiot=4.0, trash=4.0)
    assert total("it was trash here", m) == 4 and total("you are such trash", m) == 6 and total("trash you are", m) == 6
    assert total("he is not an idiot", m) == 1 and total("they said that he is an idiot", m) == 1
    assert total("never. An idiot", m) == 4  # a clause ends what a negation reaches
    assert total("i will kill you", m) == 1.5 * X.THREAT_WEIGHT and total("we kill time", m) == 0 and total("i will not kill you", m) == 0.25 * X.THREAT_WEIGHT
    assert total("", m) == total("nothing here", m) == 0
    sizes, clauses = m.clauses([X.folded("Fine. You IDIOT!\nok"), b"", X.folded("trash")])
    assert sizes.tolist() == [4, 0, 1] and clauses == [[(1, 2, 6.0)], [], [(0, 1, 4.0)]]


def test_hashes_tell_words_and_beginnings_by_their_letters_only():
    texts = ["abcdefgh x", "y abcdefgh", "züabcdefghij abcdefgh abcd" + "w" * 700, "abcdefgx"]
    words = X.Words([X.folded(t) for t in texts])
    flat = [w for t in texts for w in t.split()]
    assert words.count == len(flat) and words.text.tolist() == [0, 0, 1, 1, 2, 2, 2, 3]
    seen = {}
    for k, (own, hashes) in zip((None, *X.PREFIXES), words.features()):
        for i, h in zip(own.tolist(), hashes.tolist()):
            name = (k, flat[i].encode()[:k] if k else flat[i].encode())
            assert seen.setdefault(name, h) == h
        assert k is None or own.tolist() == [i for i, w in enumerate(flat) if len(w.encode()) > k]
    assert len(set(seen.values())) == len(seen)


def test_copies_teach_no_insult(spark):
    """A word of many neighbours is learned; words of one passage that a group of near copies shares are not."""
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}o" for a in "bcdfghklmn" for b in ("ara", "eri", "ilu", "omu", "uta", "epo")]
    plain = lambda n=20: list(rng.choice(vocab, n))
    passage = ["uniquea", "uniqueb", "uniquec"]
    rows = []
    for i in range(400):
        words = plain()
        if i % 4 == 0:
            words[rng.integers(1, 19)] = "zork" + str(rng.choice(["ing", "ed", "elo"]))
        elif i % 4 == 1:
            words = ["start", *passage, *["same"] * 20, str(i)]
        rows.append((i, " ".join(words), int(i % 4 < 2)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    m = X.train(docs, labels)
    assert total("a zorkable text", m) > 0 and total(" ".join(passage), m) == 0 and total(" ".join(vocab), m) == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from spanlens.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(got) == len(ids) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if r.doc_id in english and got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_awkward_rows(spark):
    docs = R.edge_docs(spark).withColumn("toxicity", F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1), (10, None), (99, 1), (8, 0)], "doc_id bigint, toxic int")
    for m in (X.train(docs, labels), X.train(docs, labels.limit(0)), X.train(docs.limit(0), labels), X.train(docs, labels.where("toxic = 1"))):
        got = X.score_texts(docs, m).select("text", "toxicity", "toxicity_1").collect()
        assert len(got) == len(R.TEXTS) and {r.toxicity for r in got} == {"own"}
        assert all(0 <= r.toxicity_1.score < 0.5 for r in got if r.toxicity_1.total == 0)
        assert all(r.toxicity_1.n_words == 0 for r in got if not (r.text or "").strip())
        assert X.score_texts(docs.limit(0), m).count() == 0
    assert spark.createDataFrame([(None,), (3,)], "a int").select(X.is_held_out(F.col("a")).alias("h")).where("h IS NULL").count() == 0
