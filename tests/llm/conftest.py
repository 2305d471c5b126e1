import pytest


@pytest.fixture(scope="session")
def write(tmp_path_factory):
    """Writes DataFrames as the tables of a data folder."""

    def make(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return make
