"""Shared folder of a session with and without the setting."""

import pytest

from treespark import session


class Context:
    applicationId = "app-of-test"

    def __init__(self, master):
        self.master = master


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), Conf(folder)


def test_shared_folder():
    assert session.shared_dir(Session("spark://host:1", "file:///shared")) == "file:///shared"
    local = session.shared_dir(Session("local[2]"))
    assert local == session.shared_dir(Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://host:1"))
