"""Named queries and their SQL, by area."""

MODULES = ["nested", "search", "graph", "evaluate", "ingest", "pipelines", "answers", "events", "listings", "profiles", "doctree", "texts", "files"]
