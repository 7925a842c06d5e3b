"""Alignment of two tokenizers against a plain restatement over whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from lodestone.llm import alignment
from lodestone.llm.alignment import Alignment


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def intervals(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts, a, b):
    letters = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    byte = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}
    rows, counts = [], Counter()
    for t in texts:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        in_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids_a]
        in_b = []
        for i in b.encode(t or "", num_threads=1):
            piece = b.id_to_piece(i)
            in_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in in_a) != whole or b"".join(x for _, x in in_b) != whole:
            rows.append(None)
            continue
        xs, ys = intervals(in_a), intervals(in_b)
        links = [(i, j) for i, s, e in xs for j, u, v in ys if u < e and s < v]
        ends = sorted({e for *_, e in xs} & {e for *_, e in ys})
        groups = [
            ",".join(str(i) for i, s, _ in xs if lo <= s < hi) + "|" + ",".join(str(i) for i, s, _ in ys if lo <= s < hi)
            for lo, hi in zip([0, *ends], ends, strict=False)
        ]
        rows.append((len(xs), len(ys), ends, links, ";".join(groups)))
        counts.update(set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = r[3]
        out.append((r[0], r[1], len(r[2]), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(r[4].encode()).hexdigest()))
    return out, counts, best


ODD = [
    "plain words, twice. plain words.", None, "", " ", "  ", "x ", " x", "a  b   c\n\n d \t e", "é日本語 <|endoftext|> <s> <0x41> <unk>", "with▁mark", "nul\0byte",
    "tab\t", "\n", "x  y  z", "don't we'll 's 12345 67", "🙂🙂 👩‍👩‍👧", "ñandú  ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "plain words, twice. plain words.", "x​ y", "\x1f z",
]


def check(spark, documents, texts, a, b):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    found = Alignment(documents(rows), texts=True)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected, counts, best = brute(texts, a, b)
    ours = Counter((r["doc_id"], *(r[c] for c in names)) for r in found.scores().collect())
    assert ours == Counter((d, *e) for (d, _), e in zip(rows, expected, strict=True))
    assert {(r["a"], r["b"]): r["docs"] for r in found.pair_counts().collect()} == dict(counts)
    assert {(r["a"], r["b"]) for r in found.pair_counts().where("best").collect()} == {p for p, n in counts.items() if n == best[p[0]]}
    return found


def test_odd_texts(spark, documents, tokenizers_):
    found = check(spark, documents, ODD, *tokenizers_)
    assert {r["groups"] for r in found.groups().where("doc_id = 9").collect()} == {""}, "the mark comes back as a space: no tokens"
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "日", ".", "'", "ll", "7", "🙂", " ", "\r", "<s>", "▁"[:0], " "]
    check(spark, documents, ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(300)], *tokenizers_)


def test_documents_of_the_table(spark, documents, table, tokenizers_):
    check(spark, documents, [r["text"] for r in table("documents").orderBy("doc_id").limit(60).collect() if len(r["text"] or "") < 4000], *tokenizers_)


def test_long_words_small_memories_and_shuffled_pairs(spark, documents, tokenizers_, monkeypatch):
    monkeypatch.setattr(alignment, "SHARE", 20)  # read by the driver; the other bounds by the class itself
    check(spark, documents, ["one two", "two three", "three one two", "x" * 50] * 4, *tokenizers_)
    for name, value in (("ROUND", 40), ("WORDS", 3), ("HELD", 2), ("IN_ROW", 2)):
        monkeypatch.setattr(alignment, name, value)
    long = "ab1-é" * 200
    one = alignment.Aligner(alignment.VOCABULARY, alignment.PIECES, "200MB")
    expected, counts, _ = brute([long, "a b", long + " c"], *tokenizers_)
    merged = Counter()
    for text, row in zip([long, "a b", long + " c"], expected, strict=True):
        (groups,), totals, pairs, times = one.documents([text])
        assert tuple(totals[0]) == row[:4] and hashlib.sha256(groups.encode()).hexdigest() == row[6] and sum(times[0].as_py()) == row[3]
        for part in one.counts(last=False):
            merged.update(dict(zip(part["pairs"][0].as_py(), part["times"][0].as_py(), strict=True)))
    for part in one.counts(last=True):
        merged.update(dict(zip(part["pairs"][0].as_py(), part["times"][0].as_py(), strict=True)))
    assert merged == Counter({(i << 32) + j: n for (i, j), n in counts.items()})


def test_megabytes_in_one_text_and_no_rows(spark, documents):
    out = Alignment(documents([(1, "word and more " * 100_000), (2, "x" * 300_000)])).scores().orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == [1, 2] and out[0]["n_links"] >= 300_000 and all(r["n_groups"] for r in out)
    none = Alignment(documents([(1, "x")]).where("false")).scores()
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
