"""Work on few files is dealt out to all cores."""

from types import SimpleNamespace

import pytest

from docmill.operators.infer import infer
from docmill.settings import Settings
from workload.corpus import spread


class Rows:
    """What ``spread`` asks of a table."""

    isStreaming = False

    def __init__(self, master: str, files: int, partitions: int) -> None:
        context = SimpleNamespace(master=master, defaultParallelism=3)
        conf = SimpleNamespace(get={"spark.sql.shuffle.partitions": "12"}.get)
        self.sparkSession = SimpleNamespace(sparkContext=context, conf=conf)
        self.files, self.rdd = files, SimpleNamespace(getNumPartitions=lambda: partitions)

    def inputFiles(self) -> list[str]:
        return ["part"] * self.files

    def repartition(self, tasks: int) -> int:
        return tasks


@pytest.mark.parametrize(
    ("master", "files", "partitions", "tasks"),
    [("spark://host:7077", 1, 1, 12), ("yarn", 3, 40, 40), ("local[3]", 1, 1, 3), ("yarn", 12, 12, None)],
)
def test_few_files_are_dealt_out(master, files, partitions, tasks):
    rows = Rows(master, files, partitions)
    assert spread(rows) == (rows if tasks is None else tasks)


def test_answers_leave_the_lanes(spark):
    class Echo:
        def generate(self, task: str, document: dict) -> str:
            return "{}"

    docs = spark.range(40).selectExpr("concat('d', id) AS job_id", "concat('text ', id) AS body")
    answered = infer(docs, lambda name: Echo(), ["m"], Settings(max_retries=1), lanes=2)
    assert answered.rdd.getNumPartitions() == 4
    assert sorted(r.job_id for r in answered.collect()) == sorted(r.job_id for r in docs.collect())
