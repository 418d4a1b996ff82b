from __future__ import annotations

import pytest


@pytest.fixture
def write_tables(tmp_path):
    """Write tables as Parquet and return the folder that the queries read."""

    def write(**tables) -> str:
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
