import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")

from bibliolith.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def scan_rows():
    """Rows that the scan of a path gave, of the plan that ran."""

    def count(df, path):
        df.collect()
        stack, total = [df._jdf.queryExecution().executedPlan()], 0
        while stack:
            node = stack.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                stack.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                stack.append(node.plan())
            else:
                if name == "FileSourceScanExec" and path in node.relation().location().rootPaths().toString():
                    total += node.metrics().apply("numOutputRows").value()
                stack += [node.children().apply(k) for k in range(node.children().size())]
        return total

    return count
