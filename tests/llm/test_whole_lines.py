"""Line dedup takes out duplicate lines, short ones too, and nothing else."""

import corpus_pipeline
from brute import classes, docs, edits
from test_linededup import _texts

from scoreline.llm import queries


def _removed(texts):
    """Per text the duplicate lines: exact copies of any line that is not blank, and long ones by edits."""
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if x.strip()]

    def linked(i, j):
        a, b = lines[i][2], lines[j][2]
        return a == b or min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2
    group = classes(len(lines), linked)
    return [{i for k, (e, i, _) in enumerate(lines) if e == d and group[k] != k} for d in range(len(texts))]


def _cases():
    shared = "a licence line that very many documents share, it is long"
    return [*_texts(), shared, f"{shared}\nown line, shorter than it", f"{shared}\n{shared}\nbrief", f"{shared}\n\n",
            "All rights reserved\n全角の文が一つ。\nfirst text of the two", "second of them\n\n全角の文が一つ。\nAll rights reserved\n "]


def test_stage_keeps_every_line_of_its_own(spark):
    texts, want = _cases(), {}
    for d, (t, gone) in enumerate(zip(texts, _removed(texts))):
        lines = [x for i, x in enumerate((t or "").split("\n")) if i not in gone]
        if not gone or any(x.strip() for x in lines):
            want[d] = None if t is None else "\n".join(lines)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), "").collect()}
    assert got == want


def test_registered_query_reports_short_lines(spark, tmp_path):
    texts = _cases()
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: set(r.removed) for r in queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(_removed(texts)))
