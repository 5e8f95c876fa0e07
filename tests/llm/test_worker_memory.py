"""Workers of the pipeline hold nothing for later stages."""

from types import SimpleNamespace

import pyarrow as pa

from tidewater.llm import tokens


def test_lean_encoders_end_with_their_tasks(monkeypatch, tmp_path):
    context = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)
    monkeypatch.setattr(tokens, "TaskContext", SimpleNamespace(get=lambda: context))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a few words", None, "others\n  and more"])], ["doc_id", "text"])

    def task(name, keep):
        (tmp_path / name).mkdir()
        tokens.encoder_of.cache_clear()
        [made] = tokens._writer(f"file://{tmp_path}/{name}", tokens.default_tokenizer(), tokens.END, keep)(iter([batch]))
        return made.to_pylist(), [(tmp_path / name / f"part-000000-0.{x}").read_bytes() for x in ("ids", "offsets", "docs")]

    lean = task("lean", tokens.LEAN)
    assert tokens.encoder_of.cache_info().currsize == 0
    assert lean == task("full", tokens.Keep()) and tokens.encoder_of.cache_info().currsize == 1
