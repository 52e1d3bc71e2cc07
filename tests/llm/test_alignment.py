import hashlib
import os
import sys
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from llm_cases import awkward, empty  # noqa: E402

from flowlake.llm import alignment, queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Both tokenizers used as the contract says, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = alignment.byte_letters()
        self.bytes_a = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(self, ids, spelled):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spelled(i))))
            at = out[-1][2]
        return out

    def document(self, text):
        if not text:
            return [], [], [], []
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        ids_b = self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a, ids_a)) != whole or b"".join(map(self.bytes_b, ids_b)) != whole:
            return [], [], [], []
        sa, sb = self.spans(ids_a, self.bytes_a), self.spans(ids_b, self.bytes_b)
        groups, x, y, ends = [], [], [], {e for *_, e in sa} & {e for *_, e in sb}
        j = 0
        for i, _, end in sa:
            x.append(i)
            if end in ends:
                while not y or sb[j - 1][2] != end:
                    y.append(sb[j][0])
                    j += 1
                groups.append((x, y))
                x, y = [], []
        links, j = [], 0
        for i, lo, hi in sa:
            while sb[j][2] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < hi:
                links.append((i, sb[k][0]))
                k += 1
        return ids_a, ids_b, groups, links


def wanted(texts):
    plain = Plain()
    found = [plain.document(t) for t in texts]
    counts = Counter(link for *_, links in found for link in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links in found:
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(listed.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), sha))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_registered_alignment_matches_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in rows], wanted([r["text"] for r in rows])))
    got = queries.op13_alignment(spark, small)
    assert set(got.columns) == {"doc_id", *COLUMNS}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


ODD = [
    "aaaa aaaaa aaaaaaaaaa      b",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    "a▁b",
    "  \u0085\x1c\x1d x\ty\r\n\n z  ",
    "日本語 テスト \U0001f600\U0001f468‍\U0001f469 नमस्ते",
    "\x00\x01 zero",
    "It's they'll 'S  ''ve 12345 ½ ² Ⅷ",
    "ǅ ɏ Ω ß ſt",
    " leading and trailing ",
    "ümlaut" * 300,
]


def test_awkward_texts_and_few_counts_at_hand(spark):
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()] + [(100 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(k, t, 1, 2, "p") for k, t in rows], "doc_id bigint, text string, row int, n_a int, plain string")
    want = sorted(map(repr, zip([k for k, _ in rows], wanted([t for _, t in rows]))))
    for frequent in (alignment.FREQUENT, 3, 0):
        found = alignment.align(frame, A, B, frequent=frequent)
        assert sorted(repr((r["id"], tuple(r[c] for c in COLUMNS))) for r in found.collect()) == want
    assert any(w[0] == 0 for w in wanted(["a▁b"]))


def test_no_documents(spark):
    assert alignment.align(empty(spark), A, B).count() == 0


def test_the_frequent_pairs_are_bounded(spark):
    pairs = spark.createDataFrame([(i, 1 + i // 10) for i in range(1000)], "code bigint, n bigint")
    for limit in (0, 1, 50, 999, 5000):
        lowest = alignment._least_frequent(pairs, limit)
        assert pairs.where(f"n >= {lowest}").count() <= limit
