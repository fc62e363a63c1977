import logging

import pytest
import yaml

from tidemark.config import Config, ConfigError, load_config
from tidemark.log import set_up


def raw(**sync):
    return {"source": {"path": "/a"}, "target": {"path": "/b"}, "sync": sync}


def test_defaults():
    s = Config.of(raw()).sync
    assert (s.parallel_tables, s.chunk_size, s.batch_insert_size, s.tables) == (4, 50_000, 5_000, ())
    assert Config.of(raw(tables=None)).sync.tables == ()


@pytest.mark.parametrize("name", ["parallel_tables", "chunk_size", "batch_insert_size", "waves"])
@pytest.mark.parametrize("value", [0, -1, 1.5, "7", True])
def test_sizes_are_checked(name, value):
    with pytest.raises(ConfigError):
        Config.of(raw(**{name: value}))


@pytest.mark.parametrize("bad", [None, [], {"source": {}, "target": {}}, {"source": {"path": ""}, "target": {"path": "x"}, "sync": {}}, {"source": {"kind": "tape"}, "target": {"path": "x"}, "sync": {}}, raw(chunksize=3)])
def test_bad_documents(bad):
    with pytest.raises(ConfigError):
        Config.of(bad)


def test_mysql_settings_are_all_needed():
    whole = {"host": "h", "port": 3306, "user": "u", "password": "p", "database": "d"}
    assert Config.of({"source": whole, "target": {"path": "x"}, "sync": {}}).source.kind == "jdbc"
    for k in whole:
        with pytest.raises(ConfigError):
            Config.of({"source": {x: y for x, y in whole.items() if x != k}, "target": {"path": "x"}, "sync": {}})


def test_load_and_sample(tmp_path):
    from pathlib import Path

    import tidemark

    assert load_config(str(Path(tidemark.__file__).parent / "config.yaml")).source.settings["host"] == "db.example.org"
    p = tmp_path / "ü.yaml"
    p.write_text(yaml.safe_dump(raw(tables=["täble"]), allow_unicode=True), encoding="utf-8")
    assert load_config(str(p)).sync.tables == ("täble",)


def test_logging_to_a_file(tmp_path):
    log = tmp_path / "x.log"
    set_up(logging.INFO, str(log))
    logging.getLogger("here").info("grüße")
    set_up()
    assert "[INFO] here: grüße" in log.read_text(encoding="utf-8")
