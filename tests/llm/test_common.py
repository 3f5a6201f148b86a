import re
from pathlib import Path

from skein.llm.common import releasing


def held():
    """MB of this process."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) / 1000


def test_a_task_gives_its_memory_back():
    last = []

    def run(batches):
        for batch in batches:
            blocks = [bytearray(b"x") * 100_000 for _ in range(2000)]
            last.append(bytearray(b"x" * 100_000))  # lies above the blocks, so that these are not given back by themselves
            assert held() > before + 150
            del blocks
            yield batch

    before = held()
    assert list(releasing(run)(iter([1, 2]))) == [1, 2]
    assert held() < before + 50
