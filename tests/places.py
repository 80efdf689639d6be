"""Folders that the tests read. A module of its own: ``conftest`` is a name that several test folders use."""

import os

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
