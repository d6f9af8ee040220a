"""The alignment of two tokenizers against a plain loop over tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import alignment

P = pytest.importorskip("public_tokenizers")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "one", "one", "One  two\n\nthree \t four", "漢字かな ñandú É é 😀😀", "<|endoftext|> <s> </s> <unk> <0x41>", "a ▁ b",
    "x" * 3000, "= " * 500, "=" * 777, "ſﬁ ​ 　 \x00 end", "it's we'll 12345 67 " * 40, "\r\n\t" * 30, "aa ▁", "ok",
]


def plain(texts):
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names = {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, held = [], Counter()
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba, bb = [alignment.byte_level(names[i]) for i in ia], [piece(i) for i in ib]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            docs.append(None)
            continue
        ends = lambda parts: list(np.cumsum([len(x) for x in parts]))
        ea, eb = ends(ba), ends(bb)
        groups, lo = [], 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(ia, ea, strict=True) if lo < e <= cut], [i for i, e in zip(ib, eb, strict=True) if lo < e <= cut]))
            lo = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        docs.append((len(ia), len(ib), groups, links))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), said))
    return out


@pytest.mark.parametrize("few, made", [(16, 4 << 20), (0, 50), (1, 1)])
def test_links_match_a_plain_loop(spark, monkeypatch, few, made):
    monkeypatch.setattr(alignment, "FEW", few)
    monkeypatch.setattr(alignment, "MADE", made)
    by = alignment.Tokenizers(*PATHS)
    import pyarrow as pa

    found = alignment.Aligned(by, pa.array(TEXTS, pa.string()))
    want = plain(TEXTS)
    sums = found.sums()
    assert [tuple(int(sums[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links")) for i in range(len(TEXTS))] == [w[:4] for w in want]
    off, pair, times = found.pairs()
    assert [int(times[lo:hi].sum()) for lo, hi in zip(off[:-1], off[1:], strict=True)] == [want[i][3] for i in found.rows]
    assert all((np.diff(pair[lo:hi]) > 0).all() for lo, hi in zip(off[:-1], off[1:], strict=True))


def test_ranks_part_texts_as_the_library_does(tmp_path):
    import tokenizers

    by, library = alignment.Tokenizers(*PATHS), tokenizers.Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    assert by.ranked is not None
    for lo in range(0, 0x30000, 16):
        said = "".join(f" x{c}x 1{c}1 .{c}. {c}{c} {c}\n{c}  {c}" for c in map(chr, range(lo, lo + 16)) if not 0xD800 <= ord(c) < 0xE000)
        assert by.encode_a(said).tolist() == library.encode(" " + said, add_special_tokens=False).ids
    import json

    told = json.load(open(PATHS[0]))
    told["model"]["merges"][10:12] = told["model"]["merges"][11:9:-1]
    (tmp_path / "other.json").write_text(json.dumps(told))
    other = alignment.Tokenizers(f"{tmp_path}/other.json", PATHS[1])
    assert other.ranked is None and other.encode_a("<|endoftext|> as it is").tolist() == by.encode_a("<|endoftext|> as it is").tolist()


def test_whole_operator(spark):
    rows = [(i if i != 4 else None, t, "n", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, unit long").repartition(3)
    want = sorted(zip([-1 if i == 4 else i for i in range(len(TEXTS))], plain(TEXTS), strict=True))
    got = alignment.aligned_links(docs, *PATHS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in got) == want
    got = alignment.aligned_links(docs, *PATHS, digests=True).collect()
    assert {r.groups for r in got} == {hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for _, w in want}
    assert alignment.aligned_links(docs.limit(0), *PATHS).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in alignment.op11_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == [(i, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for i, w in enumerate(plain(TEXTS))]
