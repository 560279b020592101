"""The whole pipeline against its stages worked out one by one in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from graphmill.llm import toxicity


def near(a, b):
    return len(a & b) * 100 >= 80 * len(a | b)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def without_repeats(rows, length):
    first, out = {}, {}
    for i in sorted(rows):
        for k in range(len(rows[i]) - length + 1):
            first.setdefault(rows[i][k : k + length], i)
    for i, t in rows.items():
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                mark[k : k + length] = b"\1" * length
        out[i] = "".join(c for c, m in zip(t, mark, strict=True) if not m)
    return out


def targets(sizes):
    """Shares of 150 % by weight, stopped at twice a source's size, the rest shared anew."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, todo, out = 1.5 * sum(sizes.values()), set(order), {}
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in todo}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        todo -= full
    return out


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, passage = {}, text(60)
    for i in range(160):
        rows[i] = text(r.randint(15, 90))
    for i in range(0, 160, 10):
        rows[i] += " snorfle gribbet " + text(4)  # toxic
    for k, i in enumerate(range(200, 212)):  # near copies and copies
        w = rows[2 * k + 1].split()
        w[len(w) // 2] = "changed" if k % 2 else w[len(w) // 2]
        rows[i] = " ".join(w)
    for i in range(220, 226):
        rows[i] = f"{text(40)} {passage} {text(30)}"
    rows |= {300: None, 301: "", 302: "one two"}
    source = {i: ["a", "b", "c", None][i % 4] for i in rows}
    docs = spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    clean = {x.doc_id for x in toxicity.score_documents(docs, labels).collect() if x.score < 0.3}
    assert clean == {i for i in rows if i >= 160 or i % 10}
    sets = {i: shingles(rows[i] or "") for i in sorted(clean)}
    kept = []
    group = {}
    for i in sets:
        todo = [i]
        while todo:
            at = todo.pop()
            if at not in group:
                group[at] = group.get(i, i)
                todo += [j for j in sets if j != at and sets[at] and sets[j] and near(sets[at], sets[j])]
    kept = [i for i in sets if group[i] == i]
    assert not set(range(200, 212)) & set(kept)
    cleaned = without_repeats({i: rows[i] or "" for i in kept}, corpus_pipeline.PASSAGE_BYTES)
    assert all(passage not in cleaned[i] for i in range(221, 226)) and passage in cleaned[220]
    size = {i: len(t.split()) for i, t in cleaned.items()}
    sizes = {}
    for i in cleaned:
        sizes[source[i]] = sizes.get(source[i], 0) + size[i]
    goal = targets(sizes)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in cleaned.items():
        rate = goal[source[i]] / sizes[source[i]] if sizes[source[i]] else 0.0
        draw = int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:8], 16) / 2**32
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        copies = int(rate) + (draw < rate - int(rate))
        if copies:
            want[i, len(ids), zlib.crc32(ids.tobytes())] += copies
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.doc_tokens, x.ids_crc32) for x in got) == want
    ends = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0) and x.start == 0
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048 and len(ends) <= sum(ends.values()) / 2048 * 1.1 + 1


def test_stages_keep_their_columns(spark, tmp_path):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "a b", None, None, 3), (2, None, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns, name
            assert (out.count() > 0) == (rows.limit(1).count() > 0), name
