import pyarrow.fs as pafs
import pytest

from lettermill.llm import folders


def test_local_names(tmp_path):
    for given in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        system, root = folders.open_folder(given)
        assert isinstance(system, pafs.LocalFileSystem) and root == str(tmp_path)


@pytest.mark.parametrize(("given", "asked"), [("s3a://box/a/b", "s3://box/a/b"), ("s3n://box/a", "s3://box/a"),
                                              ("hdfs://host:8020/a", "hdfs://host:8020/a")])
def test_schemes_of_spark(monkeypatch, given, asked):
    class Asked:
        @staticmethod
        def from_uri(uri):
            return None, uri

    monkeypatch.setattr(folders.pafs, "FileSystem", Asked)
    assert folders.open_folder(given) == (None, asked)
