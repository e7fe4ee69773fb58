from sparkroster.schemas import CHANGES, ENTRIES, INVENTORY


def inventory(spark, *rows):
    """Rows are (namespace, id, name, environment) with further fields by keyword."""
    full = []
    for r in rows:
        r = dict(r)
        labels = {
            key: r[c]
            for c, key in (
                ("project_id", "project-id"),
                ("project_name", "project-name"),
                ("environment", "environment"),
                ("repo_name", "repo-name"),
                ("depends_on", "depends-on"),
            )
            if r.get(c) is not None
        }
        full.append(
            (
                r["namespace"],
                r.get("project_id"),
                r.get("project_name"),
                r.get("environment"),
                r.get("repo_name"),
                r.get("depends_on"),
                labels,
                r.get("annotations"),
                r.get("phase"),
                r.get("created_at"),
            )
        )
    return spark.createDataFrame(full, INVENTORY)


def ns(project_id, name, environment, **more):
    return {
        "namespace": f"{project_id}-{environment}",
        "project_id": project_id,
        "project_name": name,
        "environment": environment,
        **more,
    }


def entries(spark, data):
    """{name: map} as entries."""
    return spark.createDataFrame(
        [("secret", "default", name, None, d) for name, d in data.items()], ENTRIES
    )


def changes(spark, *rows):
    """(name, seq, op, map) as changes."""
    return spark.createDataFrame(
        [("secret", "default", name, seq, op, d) for name, seq, op, d in rows], CHANGES
    )


def as_dict(df):
    return {r["name"]: r["data"] for r in df.select("name", "data").collect()}


def statuses(df, *by):
    by = by or ("name", "seq")
    return {tuple(r[b] for b in by) if len(by) > 1 else r[by[0]]: r["status"] for r in df.collect()}
