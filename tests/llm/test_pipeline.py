import random

import corpus_pipeline
import sentencepiece
from llm.test_linededup import plain as dropped_lines
from llm.test_simhash import plain as mark

from skein.llm.queries import piece_model


def corpus():
    """Documents of two languages with copies, near copies, shared lines, and texts of no language."""
    rng = random.Random(3)
    vocabulary = {"en": ["the", "house", "stands", "over", "water", "and", "light", "falls", "through", "windows"], "de": ["das", "haus", "steht", "über", "wasser", "und", "licht", "fällt", "durch", "fenster"]}
    rows = []
    for doc_id in range(60):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choice(vocabulary[lang]) + str(rng.randint(0, 400)) for _ in range(30)) for _ in range(3)]
        if doc_id % 4 == 0:
            lines.insert(1, "this shared line stands in many of the documents")
        rows.append((doc_id, "\n".join(lines), lang, f"src{doc_id % 3}"))
    rows += [(60, rows[7][1], rows[7][2], "src0"), (61, rows[8][1].upper(), rows[8][2], "src1"), (62, "1234 5678 !!", "en", "src1"), (63, None, "en", "src2"), (64, "", None, None)]
    return rows


def run_stage(spark, name, docs, folder):
    out = str(folder / name)
    dict(corpus_pipeline.STAGES)[name](spark, docs, "unused").write.parquet(out)
    return spark.read.parquet(out)


def test_stages_equal_plain_versions(spark, frame, tmp_path):
    docs = frame(corpus())
    columns = docs.columns

    one = run_stage(spark, "language_id", docs, tmp_path)
    assert one.columns == columns
    assert {r["doc_id"] for r in one.collect()} == {r[0] for r in corpus()} - {62, 63, 64}

    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    gone, want = dropped_lines(rows), {}
    for doc_id, text in rows:
        left = [line for i, line in enumerate(text.split("\n")) if i not in gone.get((doc_id, text), [])]
        if "\n".join(left).strip():
            want[doc_id] = "\n".join(left)
    two = run_stage(spark, "line_dedup", one, tmp_path)
    assert two.columns == columns
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and 60 not in want and 61 not in want
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())

    kept, marks = set(), []
    for doc_id in sorted(want):
        own = mark(want[doc_id])
        if all((own ^ m).bit_count() > 3 for m in marks):
            kept.add(doc_id)
        marks.append(own)
    three = run_stage(spark, "simhash_dedup", two, tmp_path)
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == kept

    four = run_stage(spark, "source_mix", three, tmp_path)
    assert four.columns == columns
    sizes, taken = {}, {}
    for r in three.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in four.collect():
        assert want[r["doc_id"]] == r["text"]
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    from llm.test_mixing import target

    for source, goal in target(sizes).items():
        assert abs(taken[source] - goal) <= 100

    judge = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    five = run_stage(spark, "sentencepiece", four, tmp_path).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in five) == sorted((r["doc_id"], len(judge.encode(r["text"]))) for r in four.collect())
    assert all(r["round_trip"] and r["parity"] for r in five)


def test_awkward_rows_go_through_every_stage(spark, frame, tmp_path):
    from llm.rows import AWKWARD

    for kind in (AWKWARD, []):
        docs = frame(kind)
        folder = tmp_path / str(len(kind))
        for name, _ in corpus_pipeline.STAGES:
            alone = run_stage(spark, name, frame(kind), folder / "alone")
            assert name == "sentencepiece" or alone.columns == docs.columns
        for name, _ in corpus_pipeline.STAGES:
            docs = run_stage(spark, name, docs, folder)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"] and out.count() > 0


def test_fingerprints_are_linked(spark, frame, tmp_path):
    """texts whose five-word shingles differ, but whose fingerprints differ in at most three bits, are one document."""
    head, tail = [f"w{i}" for i in range(7)], ["a", "b", "c"]
    # Many repeats of one sequence outweigh its ends in the fingerprint; as a set, the ends are most of the shingles.
    rows = [(i, " ".join(head * 40 + [f"{x}{i}" for x in tail for _ in range(2)]), "en", "src") for i in range(2)]
    assert (mark(rows[0][1]) ^ mark(rows[1][1])).bit_count() <= 3
    from skein.llm.neardocs import shingle_set

    a, b = (set(shingle_set(r[1]).tolist()) for r in rows)
    assert len(a & b) / len(a | b) < 0.8
    kept = run_stage(spark, "simhash_dedup", frame(rows), tmp_path)
    assert [r["doc_id"] for r in kept.collect()] == [0]
