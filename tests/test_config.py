from types import SimpleNamespace

import pytest

from graphloom.sources import config


def test_quality_config(tmp_path):
    path = tmp_path / "c.toml"
    assert config.quality_config(str(path))["LongFunction"] == 50
    path.write_text("[quality]\nlong_function = 80\nmagic = 3\n[frameworks]\nx = 1\n")
    assert config.quality_config(str(path))["LongFunction"] == 80
    path.write_text("[quality]\ndeep_nesting = 21\n")
    with pytest.raises(ValueError, match="DeepNesting"):
        config.quality_config(str(path))


def test_manifest_updates(tmp_path):
    path = tmp_path / "package.json"
    path.write_text('{"name": "n", "dependencies": {"b": "1", "a": "^1"}, "devDependencies": {"a": "2"}}')
    assert config.update_manifest(str(path), {("Runtime", "a"): "^2"}, dry_run=True) == [("Runtime", "a", "^1", "^2")]
    assert '"^1"' in path.read_text()
    config.update_manifest(str(path), {("Runtime", "a"): "^2"})
    assert path.read_text().index('"b"') < path.read_text().index('"^2"')
    cargo = tmp_path / "Cargo.toml"
    cargo.write_text('# top\n[dependencies]\nserde = "1.0" # keep\ntokio = { version = "1", features = ["x"] }\n[dev-dependencies]\nserde = "0.9"\n')
    assert config.update_cargo_manifest(str(cargo), {("Runtime", "serde"): "2.0", ("Runtime", "tokio"): "1.5"}) == [("Runtime", "serde", "1.0", "2.0"), ("Runtime", "tokio", "1", "1.5")]
    assert cargo.read_text() == '# top\n[dependencies]\nserde = "2.0" # keep\ntokio = { version = "1.5", features = ["x"] }\n[dev-dependencies]\nserde = "0.9"\n'


def test_backends():
    backends = config.Backends()
    a, b = (SimpleNamespace(name=n, extensions=x, analyze=None) for n, x in (("Script", ("js", "ts")), ("Other", ("ts",))))
    backends.register(a)
    backends.register(b)
    assert backends.for_path("x/y.ts") is a
    assert backends.by_name("OTHER") is b
    assert backends.for_path("x.py") is None
