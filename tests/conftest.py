import pytest

from tallywell.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[4]", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
