"""Training-data operators that go beyond record pipelines; nothing outside this subpackage imports it."""
