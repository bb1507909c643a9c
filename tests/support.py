"""Paths that the tests share. A module of its own: ``conftest`` is a name that every test folder
may use, so it cannot be imported from."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
