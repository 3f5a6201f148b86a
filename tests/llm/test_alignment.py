"""Token alignment against a plain walk with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from skein.llm import alignment
from tests.llm.rows import AWKWARD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    names = {i: n for n, i in first.get_vocab(with_added_tokens=True).items()}
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    table = alignment._byte_of()
    out, counts = [], Counter()
    for doc_id, text, *_ in rows:
        found = None
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            raw_a = [bytes(table[c] for c in names[i]) for i in a]
            pieces = [second.id_to_piece(i) for i in b]
            raw_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                i = j = end_a = end_b = 0
                groups, links, group = [], [], ([], [])
                while i < len(a) or j < len(b):
                    if end_a == end_b:
                        end_a, end_b = end_a + len(raw_a[i]), end_b + len(raw_b[j])
                        group = ([a[i]], [b[j]])
                        groups.append(group)
                        i, j = i + 1, j + 1
                    elif end_a < end_b:
                        end_a += len(raw_a[i])
                        group[0].append(a[i])
                        i += 1
                    else:
                        end_b += len(raw_b[j])
                        group[1].append(b[j])
                        j += 1
                    links.append((a[i - 1], b[j - 1]))
                counts.update(links)
                found = a, b, groups, links
        out.append((doc_id, found))
    high = {}
    for (_, b), n in counts.items():
        high[b] = max(high.get(b, 0), n)
    rows = []
    for doc_id, found in out:
        if found is None:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[x] == high[x[1]] for x in links)
        rows.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


def check(df, rows):
    got = alignment.align_texts(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


ODD = [
    (100, "a <|endoftext|> b <s> </s> <unk> <0x41>", "en", "a"), (101, "▁ marker", "en", "a"), (102, "two  spaces and\ttabs \n lines", "en", "a"),
    (103, " leading", "en", "a"), (104, "trailing ", "en", "a"), (105, "don't we'll x's 12,345.67 end.", "en", "a"), (106, "日本語テキスト naïve ﬁ ½", "en", "a"),
    (107, " ", "en", "a"), (108, "a a a, a. a", "en", "a"), (109, " no break　", "en", "a"),
]


def test_awkward_texts(frame):
    check(frame(AWKWARD + ODD), AWKWARD + ODD)
    check(frame([]), [])
    check(frame([(1, None, "en", "a"), (2, "", "en", "a")]), [(1, None), (2, "")])


def test_several_tasks(frame):
    rows = [(i, f"word{i % 7} and the same words {'x' * (i % 11)}.", "en", "a") for i in range(400)] + ODD
    check(frame(rows).repartition(5), rows)


def test_given_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])
