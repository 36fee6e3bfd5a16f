"""Dependency manifests and README texts: (project_id, rel_path, text) in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import fixed
from codelode.functions.text import file_name


def framework_hints(manifests: DataFrame) -> DataFrame:
    """(project_id, framework) of which a manifest's lower-cased text has the keyword."""
    rows = []
    for name, words in fixed.FRAMEWORKS.items():
        rules = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(f).alias("f")) for w, f in words.items()))
        hits = F.filter(rules, lambda r: F.contains(F.lower("text"), r["w"]))
        rows.append(F.when(file_name(F.col("rel_path")) == name, F.transform(hits, lambda r: r["f"])))
    found = F.coalesce(*rows, F.array().cast("array<string>"))
    return manifests.select("project_id", F.explode(found).alias("framework")).distinct()


def dependencies(manifests: DataFrame) -> DataFrame:
    """(project_id, manager, name, development). pyproject counts only without requirements.txt."""
    name, text = file_name(F.col("rel_path")), F.col("text")
    bare = lambda x: F.trim(F.element_at(F.split(x, fixed.REQUIREMENT_END), 1))
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    pip = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-")), bare)
    quoted = F.regexp_extract_all(F.regexp_extract(text, fixed.PYPROJECT_LIST, 1), F.lit('"([^"]+)"'), F.lit(1))
    keys = lambda field: F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{field}")), F.array().cast("array<string>"))
    skip = F.array(*map(F.lit, fixed.CARGO_OTHER))
    crates = F.filter(F.regexp_extract_all(text, F.lit(fixed.CARGO_KEY), F.lit(1)), lambda x: ~F.array_contains(skip, x))
    named = lambda manager, names, dev=False: F.transform(names, lambda x: F.struct(F.lit(manager).alias("manager"), x.alias("name"), F.lit(dev).alias("development")))
    found = (
        F.when(name == "package.json", F.concat(named("npm", keys("dependencies")), named("npm", keys("devDependencies"), True)))
        .when(name == "requirements.txt", named("pip", pip))
        .when(name == "pyproject.toml", named("pyproject", F.transform(quoted, bare)))
        .when(name == "go.mod", named("go", F.regexp_extract_all(text, F.lit(fixed.GO_MODULE), F.lit(1))))
        .when(name == "Cargo.toml", named("cargo", crates))
        .when(name == "Gemfile", named("bundler", F.regexp_extract_all(text, F.lit(fixed.GEM), F.lit(1))))
    )
    rows = manifests.select("project_id", F.explode(found).alias("d")).select("project_id", "d.manager", "d.name", "d.development").where("name <> ''")
    pip_projects = rows.where("manager = 'pip'").select("project_id").distinct()
    toml = rows.where("manager = 'pyproject'").join(pip_projects, "project_id", "left_anti").withColumn("manager", F.lit("pip"))
    return rows.where("manager <> 'pyproject'").unionByName(toml)


def description(readmes: DataFrame) -> DataFrame:
    """The first paragraph that is neither a heading nor an image, on one line, 300 characters at most."""
    paragraphs = F.transform(F.split(F.left("text", F.lit(4000)), r"\n\s*\n"), F.trim)
    first = F.get(F.filter(paragraphs, lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("!")), F.lit(0))
    return readmes.select("project_id", "rel_path", F.left(F.regexp_replace(first, r"\s*\n\s*", " "), F.lit(300)).alias("description"))
