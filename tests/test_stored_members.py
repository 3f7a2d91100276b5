"""Groups are resolved when a query first asks for them, and then stored: others don't wait for it."""

from pathlib import Path

from tessera.plans import registry
from tessera.sources.storage import shared_folder

DATA = Path("/root/testdata/sf0.001")


def test_members_are_resolved_when_asked(spark, tmp_path):
    for table in DATA.glob("*.parquet"):
        (tmp_path / table.name).symlink_to(table)
    folder = Path(shared_folder(spark))
    stored = lambda: {p for p in folder.glob("tessera-*/*/members")}
    before = stored()
    registry.QUERIES["total"](spark, str(tmp_path)).collect()
    assert stored() == before
    first, again = (sorted(map(tuple, registry.QUERIES["group_books"](spark, str(tmp_path)).collect())) for _ in range(2))
    assert first == again != [] and len(stored() - before) == 1
