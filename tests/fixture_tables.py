"""Where the driver's tables lie; a module of its own, since the name ``conftest`` belongs to each test folder."""

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
