"""Line dedup of documents that mostly repeat others."""

from vigil.llm import lines


def test_documents_of_repeated_lines_lose_them(spark):
    line = lambda d, i: f"document {d * 7919} has this as its line number {i * 104729}, {'abcdefgh'[d] * 9}"
    texts = {d: [line(d, i) for i in range(6)] for d in range(4)}
    mixed = [texts[d][i] for d in range(4) for i in (0, 1)]  # repeats of four documents
    copy = [*texts[0], texts[1][2]]  # of one document, and a line of another
    rows = [(d, "\n".join(x)) for d, x in texts.items()]
    rows += [(10, "\n".join([*mixed, "fresh"])), (11, "\n".join(mixed)), (12, "\n".join([*copy, "fresh"])), (13, "\n".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.text for r in lines.deduplicate(docs).collect()}
    assert whole == dict(rows[:4]) | {10: "fresh", 11: "", 12: "fresh", 13: ""}
    spared = {r.doc_id: r.text for r in lines.deduplicate(docs, spare_copies=True).collect()}
    assert spared == whole | {12: "\n".join([*texts[0], "fresh"]), 13: "\n".join(texts[0])}
