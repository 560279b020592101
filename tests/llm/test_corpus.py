"""Corpus operators against brute force: nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from graphmill.llm import chat, jaccard, langid, mixing, packing, repeats, rpforest, toxicity, url_filter, vptree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, so, len(t or ""), 5, 6, "x") for i, t, la, so in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(i, text(r.randint(0, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(60)]
    passage = text(60)
    out += [(60 + i, f"{text(20)} {passage} {text(5)}", "en", "a") for i in range(4)]
    out += [(70 + i, out[i % 3][1], "en", "a") for i in range(5)]
    out += [(80, out[5][1] + " new", "en", "b"), (90, None, None, None), (91, "", "en", "a"), (92, " \n", "en", "a"), (93, "é" * 90, "fr", "b"), (94, "a" * 400, "fr", "b"), (95, "a" * 300, "fr", "b"), (None, text(80), "en", "a"), (96, "word", "en", "a"), (97, "WORD", "en", "a")]
    return out


def sets_of(text, width):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def test_jaccard_components(spark, rows):
    p = jaccard.Params(width=4, num=85, den=100)
    got = {r.doc_id: r for r in jaccard.join(frame(spark, rows), p).collect()}
    s = {i: sets_of(t, 4) for i, t, *_ in rows if i is not None}
    linked = {i: [j for j in s if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])] for i in s}
    for i in s:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in linked[todo.pop()] if j not in seen and not seen.add(j)]
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(s[i]), min(seen), len(linked[i])), i
    assert jaccard.join(frame(spark, []), p).count() == 0


def test_repeats(spark, rows):
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    first = {}
    known = sorted((i, (t or "").encode()) for i, t, *_ in rows if i is not None)
    for i, b in known:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in known:
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        assert bytes(got[i].kept) == bytes(c for c, m in zip(b, mark, strict=True) if not m), i
    assert got[None].spans == []


def kept_by_brute_force(rows):
    """The bytes each (id, text) keeps: all but those under a window that a smaller id has too."""
    known = sorted((i, (t or "").encode()) for i, t in rows)
    first, out = {}, {}
    for i, b in known:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in known:
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        out[i, b] = bytes(c for c, m in zip(b, mark, strict=True) if not m)
    return out


def test_repeats_of_one_context_within_a_document(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, block = word(120), word(30)
    again = block + passage + block  # the same surroundings each time, others than in document 3
    rows = [(1, word(70) + "-" * 60 + word(20)), (2, word(30) + "-" * 400 + word(40)), (3, word(90) + passage + word(60))]
    rows += [(4, word(50) + again + word(80) + again + word(40) + again), (5, "-" * 700), (5, "-" * 700), (6, "=" * 55), (7, "=" * 500), (7, "=" * 500 + "x")]
    want = kept_by_brute_force(rows)
    got = repeats.remove_repeats(frame(spark, [(i, t, "en", "a") for i, t in rows]), keep=("text",)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert bytes(x.kept) == want[x.doc_id, x.kept_text.encode()], x.doc_id


def test_repeats_sorts_only_what_two_texts_share_on_a_side(spark, monkeypatch):
    r = random.Random(17)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    short = [word(36) for _ in range(20)]  # shared first ranks, but no side and no window is shared
    rows = [(i, word(80) + short[i % 20] + word(80), "en", "a") for i in range(40)]
    counts, shared_pairs = [], repeats.shared_pairs

    def counted(pairs):
        counts.append(pairs.count())
        return shared_pairs(pairs)

    monkeypatch.setattr(repeats, "shared_pairs", counted)
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert counts and not any(counts) and all(not x.spans for x in got)
    counts.clear()
    passages = [word(n) for n in range(45, 65)]
    rows = [(i, word(70) + passages[i % 20] + word(70), "en", "a") for i in range(60)] + [(60, "xy" * 30 + passages[19], "en", "a"), (61, "xy" * 40 + passages[19][:55] + "yx" * 50, "en", "a"), (62, "yx" * 26 + "z", "en", "a")]
    want = kept_by_brute_force([x[:2] for x in rows])
    got = repeats.remove_repeats(frame(spark, rows), keep=("text",)).collect()
    assert all(bytes(x.kept) == want[x.doc_id, x.kept_text.encode()] for x in got) and any(counts)


def test_mixing(spark, rows):
    docs = frame(spark, rows)
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(rows) and all(0 <= r.copies <= 2 for r in plan)
    by = {r.source_size: r.target for r in plan}
    assert sum(by.values()) == pytest.approx(1.5 * sum(by)) and all(t <= 2 * s for s, t in by.items())
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(frame(spark, [])).count() == 0


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    got = packing.pack_documents(frame(spark, [*rows, (200, "long words here " * 3000, "en", "a")])).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text, *_ in [*rows, (200, "long words here " * 3000, None, None)]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in mine)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_packing_learns_words_from_the_model_alone(monkeypatch):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzßäöüéèñçœſÿøÉÀİŁ0123456789'!?.,;:-()§"
    texts = [" ".join("".join(r.choice(letters[: r.choice([26, 36, 60])]) for _ in range(r.randint(1, 14))) for _ in range(400)) for _ in range(20)]
    texts += ["it's we'll they're I'd '' 'S don't", "x" * 5000 + " " + "é" * 3000, "", " \t\n"]
    plain = [t for t in texts if packing.PLAIN.fullmatch(t)]
    encoder = packing.WordEncoder()
    want = [encoder.whole(t).tolist() for t in plain]
    monkeypatch.setattr(encoder, "whole", None)  # no text and no word goes through the whole tokenizer
    assert len(plain) > 8 and [x.tolist() for x in encoder.encode_many(plain)] == want


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    assert added
    texts = [f"{before}{a}{after}" for a in [*added, *(a.upper() for a in added), *(a[:-1] for a in added), " ".join(added), "".join(added)] for before, after in (("", ""), ("one text ", " another"), ("word", "word"), ("<<", ">\n"))]
    got = {}
    for r in packing.pack_documents(frame(spark, [(i, x, "en", "a") for i, x in enumerate(texts)])).collect():
        got[r.doc_id] = (r.start, r.length, r.ids_crc32, r.doc_tokens)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (0, len(ids), zlib.crc32(ids.tobytes()), len(ids)), x


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi <|end|> <\\|text|>"), (1, 1, "assistant", "</s>[INST] né 日本 <|turn|>\n"), (1, 2, "assistant", ""), (1, 3, "assistant", "a<"), (2, 0, None, None), (2, 0, "user", "x"), (None, 1, "assistant", "y")]
    got = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    loss = "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in turns if c == 1).encode()).hexdigest()
    assert got[2].n_turns == 2 and got[None].loss_chars == 1


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.net/x?y", "http://example.net/en/1", "http://a.example.com/de/", "http://x.org/fr/1", "http://x.org/spam-farm/", "http://x.com/free/cheap", "http://x.com/freely/cheap"]
    got = [r.verdict for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(1)).orderBy("page_id").collect()]
    assert got == ["allow", "allow", "allow", "block", "allow", "block", "allow", "block", "block", "allow"]


def test_language_and_toxicity(spark):
    r = random.Random(1)
    en, de = ["the", "and", "that", "with", "house", "water"], ["der", "und", "nicht", "haus", "wasser", "schön"]
    rows = [(i, " ".join(r.choice(en if i % 2 else de) for _ in range(60)) + (" idiot grumbag" if i % 10 == 3 else ""), "en" if i % 2 else "de", "s") for i in range(200)] + [(900, None, "en", "s"), (901, "12 !", None, "s")]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in langid.predict(docs).collect()}
    assert all(got[i].lang_pred == la for i, _, la, _ in rows[:200]) and got[900].lang_pred == got[901].lang_pred == "und"
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(0, 200)], "doc_id long, toxic int")
    scored = {x.doc_id: x for x in toxicity.score_documents(docs, labels).collect()}
    assert all(scored[i].predicted == int(i % 10 == 3) for i in range(200)) and scored[900].predicted == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(rows)


def vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((12, 16))
    v = [(int(i), (base[i % 12] + 0.12 * r.standard_normal(16)).tolist(), int(i % 12 % 3)) for i in range(240)]
    v += [(500, v[0][1], 0), (501, v[0][1], None), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1)]
    return v, spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")


def test_vectors(spark):
    v, df = vectors(spark)
    ok = [(i, np.array(x), la) for i, x, la in v if x is not None and np.isfinite(x).all() and np.any(x)]
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    found = {}
    for r in vptree.search(df, df.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, x, _ in ok:
        if q % 50 == 0:
            want = sorted(((-round(cos(x, y), 12), i) for i, y, _ in ok if i != q))[:5]
            assert [i for _, i in sorted(found[q])] == [i for _, i in want]
    got = {r.vec_id: r for r in rpforest.near_duplicates(df, leaf=32).collect()}
    assert len(got) == len(v)
    for i, x, la in ok:
        assert got[i].n_links == (0 if la is None else sum(1 for j, y, lb in ok if j != i and lb == la and cos(x, y) >= 0.93))


def test_jaccard_long_list_keeps_pairs_of_different_parts(spark):
    """Forty sets in one list that is dealt in parts: only twins can link, and their parts differ for most of them."""
    p = jaccard.Params(width=4, num=85, den=100, list_part=4)
    sketch = lambda g: bytes(60 if k == g else 0 for k in range(64))
    sets = spark.createDataFrame([(i, 60, bytearray(sketch(i // 2))) for i in range(40)], "doc_id long, n long, sketch binary")
    met = spark.createDataFrame([(i, 7) for i in range(40)], "doc_id long, list long")
    pairs = {(min(r), max(r)) for r in jaccard.gathered(met, sets, p).collect()}
    assert pairs == {(2 * g, 2 * g + 1) for g in range(20)}
