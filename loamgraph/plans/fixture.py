"""A small source tree, of every kind of file that becomes knowledge, and the graph made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import graph_rows as G

REPOSITORY = "00000000-0000-0000-0000-000000000001"
TREE = [
    ("Cargo.toml", '[package]\nname = "ledger-core"\n\n[dependencies]\nserde = "1"\ntokio = { version = "1.2" }\n\n[dev-dependencies]\nproptest = "1"\n'),
    ("web/package.json", '{\n  "name": "@acme/web",\n  "dependencies": {"react": "^18.0.0", "@acme/kit": "1.0.0"},\n  "scripts": {"build": "vite build"}\n}\n'),
    ("infra/cdk.json", '{\n  "app": "npx ts-node bin/app.ts"\n}\n'),
    ("web/tsconfig.json", '{"compilerOptions": {}}\n'),
    ("docs/guide.md", "# Guide\n\nHow the ledger works.\n"),
    ("src/lib.rs", 'use std::collections::{HashMap, HashSet as Set};\n\npub struct Ledger {\n    rows: Vec<u8>,\n}\n\nimpl Ledger {\n    pub fn add(&self) {}\n}\n\nimpl Clone for Ledger {\n    fn clone(&self) -> Self {\n        todo()\n    }\n}\n\npub fn total(x: u8) -> u8 {\n    let brace = "}";\n    helper(x)\n}\n\nfn helper(x: u8) -> u8 {\n    x\n}\n\n#[test]\nfn adds() {\n    total(1);\n}\n'),
    ("app/main.py", 'import os\nfrom .store import load\n\n\nclass Runner:\n    def run(self, x):\n        return load(x)\n\n\nasync def main():\n    def inner():\n        return Runner()\n\n    inner()\n'),
    ("app/store.py", "def load(x):\n    return x\n"),
    ("app/broken.py", "def load(:\n"),
    ("web/app.ts", "import React from 'react';\nimport { kit } from '@acme/web/kit';\nimport './style';\n\nexport interface Props {\n  a: string;\n}\n\nexport type Id = string;\n\nexport enum Mode {\n  On,\n}\n\nexport const start = async (p: Props) => {\n  render(p);\n};\n\nfunction render(p: Props) {\n  return new View(p).draw();\n}\n\nexport class View {\n  constructor(private p: Props) {}\n\n  draw(): string {\n    return start(this.p);\n  }\n}\n"),
    ("infra/stack.ts", "import * as cdk from 'aws-cdk-lib';\nimport * as lambda from 'aws-cdk-lib/aws-lambda';\n\nexport class LedgerStack extends cdk.Stack {\n  constructor(scope: any) {\n    super(scope, 'x');\n    new lambda.Function(this, 'Handler', {\n      runtime: 1,\n    });\n  }\n}\n"),
    ("contracts/Vault.sol", 'pragma solidity ^0.8.0;\nimport "./Base.sol";\n\ncontract Vault is Base, Ownable(msg.sender) {\n    event Paid(uint256 amount);\n\n    modifier onlyOwner() {\n        _;\n    }\n\n    constructor() {}\n\n    function pay(uint256 amount) external onlyOwner {\n        check(amount);\n        emit Paid(amount);\n    }\n\n    function check(uint256 amount) internal {}\n}\n'),
]

#: What a later commit changes: one file is edited, one is new.
EDITED = [
    ("app/store.py", "def load(x):\n    return [x]\n\n\ndef save(x):\n    return load(x)\n"),
    ("app/extra.py", "from .store import save\n\n\ndef keep(x):\n    return save(x)\n"),
]


def files(spark: SparkSession, tree: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(REPOSITORY, p, t) for p, t in tree], "repo_id string, path string, content string")
    return rows.withColumns({"file_id": F.concat(F.lit("f:"), "path"), "content_hash": F.sha2("content", 256)})


def repositories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(REPOSITORY, "ledger", "/srv/ledger")], "repo_id string, name string, root_path string")


def graph(spark: SparkSession, tree: list[tuple[str, str]] = TREE) -> dict[str, DataFrame]:
    f = files(spark, tree)
    workspace = spark.createDataFrame([(REPOSITORY, "@acme/web")], "repo_id string, name string")
    return {"files": f.select("file_id", "repo_id", "path", "content_hash"), **G.graph(G.indexed(f), repositories(spark), workspace)}


def named_edges(graph: dict[str, DataFrame]) -> DataFrame:
    """Edges by the stable ids of their ends."""
    n = lambda c: graph["nodes"].select(F.col("node_id").alias(c), F.col("stable_id").alias(f"{c}_id"))
    return graph["edges"].join(n("source"), "source").join(n("target"), "target")
