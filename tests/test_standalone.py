import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_subpackage(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
import retrievium.sources.jsonl, retrievium.sources.connectors, retrievium.streaming.flows, retrievium.plans.pipeline
"""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if rel.parts[0] == "tests" or "llm" in rel.parts or rel.name == "corpus_pipeline.py":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(p.read_bytes())
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
