"""Code that travels: workers whose path lacks this package."""
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("names", [["op6_byte_bpe", "op9_near_dup"], ["op11_alignment", "op12_best_fit_packing", "op13_prefix_trie"]])
def test_workers_need_no_copy_of_the_package(tmp_path, names):
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        from obsframe.session import build_session
        spark = build_session("travel", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {str(tmp_path / "shared")!r},
                                                       "spark.ui.showConsoleProgress": "false", "spark.executorEnv.PYTHONPATH": ""}})
        spark.sparkContext.setLogLevel("OFF")
        from obsframe.llm import catalog
        for name in {names!r}:
            assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    """)
    file = tmp_path / "run.py"
    file.write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(file)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
