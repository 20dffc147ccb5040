import inspect
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import registry, shared, stages, toxicity
from test_text import brute_classes


def test_names():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.drop_toxic, stages.one_of_each_group, stages.drop_repeats, stages.mix_sources, stages.pack_sequences]
    names = set(registry.queries())
    assert len(names) == 11 and "pipeline" in names and set(registry.oracle_sql()) <= names
    assert all(len(inspect.signature(f).parameters) >= 2 for f in registry.queries().values())


def test_stages_keep_the_columns(spark, odd, odd_rows, sf_dir):
    for stage in (stages.drop_toxic, stages.one_of_each_group, stages.drop_repeats, stages.mix_sources):
        out = stage(spark, odd, sf_dir)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in odd.schema], stage
        out.collect()


def test_effects(spark, odd, odd_rows, nothing, sf_dir):
    kept = stages.one_of_each_group(spark, odd, sf_dir).collect()
    texts = [r.text for r in kept]
    assert len([t for t in texts if t and t.startswith(odd_rows[6][1][:50])]) == 1  # copies and the near copy
    assert len([t for t in texts if not t]) == 1  # null and empty are one text
    cut = {r.doc_id: r for r in stages.drop_repeats(spark, odd, sf_dir).filter("doc_id IN (6, 10, 13)").collect()}
    assert cut[6].text == "" and cut[6].n_chars == 0 and len(cut[13].text) > 100_000
    assert 0 < len(cut[10].text) < len(odd_rows[10][1])
    assert stages.drop_repeats(spark, odd, sf_dir).filter("text IS NULL").count() == 2
    for stage in (stages.one_of_each_group, stages.drop_repeats, stages.mix_sources, stages.pack_sequences):
        assert stage(spark, nothing, sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert rows and max(full.values()) <= 2048 and sum(full.values()) > 0.97 * 2048 * (len(full) - 1)


def test_passages_of_over_50_words_go(spark, odd, sf_dir):
    rng = random.Random(9)
    w = lambda n, k=4: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(k)) for _ in range(n))
    passage, tiny, under = w(51), w(51, 1), w(50)
    assert len(passage) < 400 and len(tiny) == 101
    own = [w(80, 9) for _ in range(8)]
    parts = [(own[0], passage, own[1]), (own[2], passage, own[3]), ("", tiny, own[4]), (own[5], tiny, ""), (own[6], under, ""), ("", under, own[7])]
    docs = spark.createDataFrame([(i, " ".join(p).strip(), "en", "s", 0, *["clash"] * 7) for i, p in enumerate(parts)], odd.schema)
    got = {r.doc_id: r.text for r in stages.drop_repeats(spark, docs, sf_dir).collect()}
    for i, (a, p, b) in enumerate(parts):
        assert got[i].split() == f"{a} {p if p is under else ''} {b}".split(), i


def brute_cut(text, raws):
    """A text without what 400-byte strings and 51-word strings that start twice cover."""
    strings, passages = brute_cut.seen.setdefault(id(raws), (Counter(), Counter()))
    words = lambda b: list(re.finditer(rb"[^\x20\x09-\x0D]+", b))
    if not strings and not passages:
        for b in raws:
            strings.update(b[i : i + 400] for i in range(len(b) - 399))
            w = [m.group() for m in words(b)]
            passages.update(tuple(w[i : i + 51]) for i in range(len(w) - 50))
    raw, gone = text.encode(), set()
    for i in range(len(raw) - 399):
        if strings[raw[i : i + 400]] > 1:
            gone.update(range(i, i + 400))
    found = words(raw)
    for i in range(len(found) - 50):
        if passages[tuple(m.group() for m in found[i : i + 51])] > 1:
            gone.update(range(found[i].start(), found[i + 50].end()))
    return bytes(x for i, x in enumerate(raw) if i not in gone).decode("utf-8", "ignore")


brute_cut.seen = {}


def test_stages_against_brute_force(spark, odd, odd_rows, sf_dir):
    docs = odd.filter("doc_id IS NULL OR doc_id <> 13")
    rows = [r for r in odd_rows if r[0] != 13]
    # near duplicates: the smallest doc_id of each class, null last
    heads = defaultdict(list)
    for (doc, text, *_), (_, class_id, copy_of, _) in zip(rows, brute_classes([(r[0], r[1]) for r in rows])):
        heads[class_id if (text or "") else "empty"].append((doc is None, doc or 0))
    got = stages.one_of_each_group(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(h) for h in heads.values())
    # repeats
    raws = [(r[1] or "").encode() for r in rows]
    want = sorted(repr((r[0], r[1] if r[1] is None else brute_cut(r[1], raws))) for r in rows)
    assert sorted(repr((r.doc_id, r.text)) for r in stages.drop_repeats(spark, docs, sf_dir).collect()) == want
    # toxicity: the rows that the operator does not reject
    labels = shared.table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train(toxicity.labelled_sample(docs, labels, 16_000)))
    want = sorted(repr(r.doc_id) for r in found.filter("score < 0.5").collect())
    assert sorted(repr(r.doc_id) for r in stages.drop_toxic(spark, docs, sf_dir).collect()) == want


def test_columns_of_any_name_stay(spark, odd, sf_dir):
    taken = ["row_0", "Row_1", "keep_0", "KEY_0", "key", "spans_0", "passages_0", "taken_0", "times_0", "copy_0", "__rid", "__spans"]
    some = odd.filter("doc_id IN (3, 6, 10)").select("doc_id", "text", "source", *[F.concat(F.lit("held "), F.col("doc_id")).alias(c) for c in taken])
    for stage in (stages.one_of_each_group, stages.drop_repeats, stages.mix_sources):
        got = stage(spark, some, sf_dir)
        assert got.columns == some.columns and all(r[c] == f"held {r.doc_id}" for r in got.collect() for c in taken), stage


def test_nothing_in(spark, nothing, sf_dir, monkeypatch):
    assert stages.drop_toxic(spark, nothing, sf_dir).count() == 0
    table = shared.table
    monkeypatch.setattr(shared, "table", lambda s, d, name: nothing if name == "documents" else table(s, d, name))
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_staged_tables_go(spark):
    t = shared.stage(spark.range(5), "five")
    path = t._staged_at.removeprefix("file://")
    import os

    assert os.path.isdir(path)
    shared.release(t)
    assert not os.path.exists(path)
