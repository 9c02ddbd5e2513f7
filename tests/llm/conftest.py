import pytest


@pytest.fixture(scope="session")
def write_tables(tmp_path_factory):
    """Writes DataFrames as ``name.parquet`` under a fresh folder; returns its path."""
    def write(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write
