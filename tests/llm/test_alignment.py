"""Cross-tokenizer alignment against a brute force that uses the tokenizers' own libraries on whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from runlens.llm import alignment

TEXTS = [
    "Hello World again", None, "", "", " ", "two  spaces\n\n\tand tabs ", "ünï ÇÀ 😀\n\nzwei é ﬁ", "a▁b <0x41> <s> <|endoftext|>", "word " * 3000, "日本語のテキスト" * 400, "x" * 5000, "Don't we'll they're 12345 " * 60,
    "the cat and the dog", "the cat and the dog", "a b" * 900, "¿Qué? ñandú corazón " * 150,
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(str(public_tokenizers.path(alignment.A_FILE)))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(alignment.B_FILE)))


def brute(texts, tokenizers):
    a, b = tokenizers
    byte, shown = alignment._printable(), {i: t for t, i in a.get_vocab().items()}
    rows, links = [], []
    for text in texts:
        raw = (" " + (text or "")).encode()
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(byte[c] for c in shown[i]) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, found, s = [], [], 0
        for e in cuts:
            ga, gb = [i for i, x in enumerate(ea) if s < x <= e], [i for i, x in enumerate(eb) if s < x <= e]
            groups.append(",".join(str(ia[i]) for i in ga) + "|" + ",".join(str(ib[i]) for i in gb))
            found += [(ia[i], ib[j]) for i in ga for j in gb if ea[i] - len(ba[i]) < eb[j] and eb[j] - len(bb[j]) < ea[i]]
            s = e
        rows.append((len(ia), len(ib), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(found)
    n = collections.Counter(p for found in links for p in set(found))
    best = {}
    for (x, _), c in n.items():
        best[x] = max(best.get(x, 0), c)
    return [(*r[:4], sum(n[p] == best[p[0]] for p in found), sum(n[p] for p in found), r[4]) for r, found in zip(rows, links)]


@pytest.mark.parametrize("chunk,fan,frequent", [(16_384, 8, 1 << 20), (50, 2, 10), (7, 3, 0), (333, 4, 200)])
def test_alignment_equals_brute_force(spark, monkeypatch, tokenizers, chunk, fan, frequent):
    for name, value in (("CHUNK", chunk), ("FAN", fan), ("FREQUENT", frequent), ("HELD", 50 if fan == 2 else 1 << 21)):
        monkeypatch.setattr(alignment, name, value)
    rnd = random.Random(chunk)
    texts = [t for t in TEXTS if chunk > 7 or not t or len(t) < 1500]
    texts += ["".join(rnd.choice(["a", " ", "the", " of", "é", "\n", "1", "!", " x", "日", "ing"]) for _ in range(rnd.randint(1, 400))) for _ in range(15)]
    # ids that are null or repeated; further columns of clashing names
    rows = [(None if i == 3 else i // 2 * 2 if i < 20 else i, t, 1, 2, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, chunk long, codes long")
    got = alignment.align_documents(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *w) for r, w in zip(rows, brute(texts, tokenizers))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_fragments_compose_in_any_order(tokenizers):
    one, two = alignment.byte_level(str(public_tokenizers.path(alignment.A_FILE))), alignment.pieces(str(public_tokenizers.path(alignment.B_FILE)))
    paths = str(public_tokenizers.path(alignment.A_FILE)), str(public_tokenizers.path(alignment.B_FILE))
    text = " " + "Antidisestablishmentarianism isn't 日本 ünï-codé, 3.14159 and so on " * 4
    cut = alignment.cut_ranges(text, 9)
    assert len(cut) > 5 and [c[0] for c in cut[1:]] == [c[1] for c in cut[:-1]]
    lows = [len(text[q:s].encode()) for s, _, q, _ in cut]
    highs = [lo + len(text[s:e].encode()) for lo, (s, e, _, _) in zip(lows, cut)]
    parts = alignment._fragments([text[q:r] for _, _, q, r in cut], np.array(lows), np.array(highs), *paths)
    (expected,) = alignment._fragments([text], np.array([0]), np.array([len(text.encode())]), *paths)
    plain = lambda x: [v.tolist() if isinstance(v, np.ndarray) else v for v in x]
    want = plain(alignment.whole(expected, one, two))
    rnd = random.Random(4)
    for _ in range(20):
        left = list(parts)
        while len(left) > 1:
            i = rnd.randrange(len(left) - 1)
            left[i : i + 2] = [alignment.compose(left[i], left[i + 1], one, two)]
        assert plain(alignment.whole(left[0], one, two)) == want


def test_empty_table_and_other_ids(spark, tokenizers):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(empty).collect() == []
    named = spark.createDataFrame([("a", "the cat"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in alignment.align_documents(named).collect()}
    assert got["a"].n_a > 0 and got[None].n_links == 0 and got[None].groups_sha256 == ""
