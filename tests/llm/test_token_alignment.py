import hashlib
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prematch.llm import token_alignment
from prematch.llm.token_alignment import Aligner, alignment, op12_token_alignment, token_groups
from prematch.llm.vocabularies import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    """Tokens, groups and links by loops over the bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters, extra = {chr(x): x for x in shown}, 256
        for x in range(256):
            if x not in shown:
                self.letters[chr(extra)] = x
                extra += 1

    def bytes_a(self, i):
        token = self.a.id_to_token(i)
        return bytes(self.letters[c] for c in token)

    def bytes_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def document(self, text):
        if not text:
            return "", [], 0, 0, 0
        a, b, whole = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_a, a)) != whole or b"".join(map(self.bytes_b, b)) != whole:
            return "", [], 0, 0, 0
        owner_a = [k for k, i in enumerate(a) for _ in self.bytes_a(i)]
        owner_b = [k for k, i in enumerate(b) for _ in self.bytes_b(i)]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, at = [([], [])], 0
        for x in range(len(whole)):
            last = x + 1 == len(whole)
            stop_a, stop_b = last or owner_a[x + 1] != owner_a[x], last or owner_b[x + 1] != owner_b[x]
            if stop_a:
                groups[-1][0].append(str(a[owner_a[x]]))
            if stop_b:
                groups[-1][1].append(str(b[owner_b[x]]))
            if stop_a and stop_b and not last:
                groups.append(([], []))
        return ";".join(",".join(g[0]) + "|" + ",".join(g[1]) for g in groups), [(a[i], b[j]) for i, j in links], len(a), len(b), len(groups)

    def corpus(self, texts):
        documents = [self.document(t) for t in texts]
        counts = Counter(p for d in documents for p in set(d[1]))
        best = {}
        for (a, _), n in counts.items():
            best[a] = max(best.get(a, 0), n)
        return [(n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if links else "")
                for text, links, n_a, n_b, n_groups in documents]


PLAIN = Plain()
ODD = [None, "", " ", "  two  spaces ", "<|endoftext|> <s></s><unk><0x41>", "▁literal mark", "naïve café", "ﬁ ﬀ", "日本語テキスト", "😀😀 ok", "a\x00b", "line\nline\r\n\ttab", "x" * 3000, "don't can't", "aaaa aaa aa a", "ÀÉ" * 40]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40) | st.sampled_from([t for t in ODD if t]) | st.text("aé ▁<>0x\n", max_size=30))
def test_groups_of_any_text(text):
    align = token_alignment.aligner(A, B)
    a, b, group_a, group_b, links = align.align(text)
    groups, pairs, n_a, n_b, n_groups = PLAIN.document(text)
    assert align.group_text(a, b, group_a, group_b) == groups
    assert (len(a), len(b)) == (n_a, n_b) and (int(group_a[-1]) + 1 if len(a) else 0) == n_groups
    assert sorted(zip(a[links[0]].tolist(), b[links[1]].tolist())) == sorted(pairs)


def as_counter(rows):
    return Counter((r.doc_id, *(getattr(r, f) for f in FIELDS)) for r in rows)


def test_corpus_counts_against_loops(spark, make_docs):
    texts = ODD + ["the same words again"] * 5 + ["the other words", "same sum, other words", "the", "the"]
    docs = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "the same")]
    from pyspark.sql import functions as F
    frame = make_docs(docs).repartition(4).withColumn("other", F.lit("user's")).withColumn("row_id", F.lit("user's"))
    expected = Counter((d[0], *e) for d, e in zip(docs, PLAIN.corpus([d[1] for d in docs])))
    for hot in (token_alignment.HOT_PAIRS, 20, 0):  # all pairs broadcast, some, none
        assert as_counter(alignment(frame, hot_pairs=hot).collect()) == expected
    assert alignment(frame.limit(0)).count() == 0
    assert {r.doc_id: r.groups for r in token_groups(make_docs([(1, "café 1"), (2, None)])).collect()} == {1: PLAIN.document("café 1")[0], 2: ""}


def test_twins_have_equal_bytes():
    align = token_alignment.aligner(A, B)
    paired = [(i, int(j)) for i, j in enumerate(align.twin) if j >= 0]
    assert len(paired) > 5000 and all(align.a.bytes[i] == align.b.bytes[j] for i, j in paired)


def test_registered_query_on_documents(spark):
    from prematch.llm.common import read_table
    folder = "/root/testdata/sf0.001"
    docs = read_table(spark, folder, "documents").collect()
    expected = Counter((d.doc_id, *e) for d, e in zip(docs, PLAIN.corpus([d.text for d in docs])))
    assert as_counter(op12_token_alignment(spark, folder).collect()) == expected
