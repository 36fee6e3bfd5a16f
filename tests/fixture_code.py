"""A small invented code base."""

FILES = {
    "src/main.py": "import os\nfrom app.store import Store\nfrom .local import x\n\n\ndef main():\n    return Store()\n\n\nif __name__ == '__main__':\n    main()\n",
    "app/store.py": "import app.models.order\n\n\nclass Store:\n    def load(self, key):\n        return key\n\n    async def save(self, key):\n        return key\n",
    "app/models/order.py": "class OrderModel:\n    pass\n\n\nclass Ok:\n    pass\n",
    "web/index.ts": "import { a } from './util';\nimport b from '../app/x';\nexport interface Shape<T> {}\ntype Name = string;\nexport class View {}\nconst run = async () => {};\nfunction go<T>(x: T) {}\n",
    "web/util.ts": "export const a = (x: number) => x;\n",
    "web/util.test.ts": "import { a } from './util';\ndescribe('jest works', () => {});\nfunction check() {}\n",
    "svc/main.go": 'package main\n\nimport "fmt"\n\ntype Server struct {\n}\n\ntype Runner interface {\n}\n\nfunc (s *Server) Start(a int) {\n}\n\nfunc main() {\n}\n',
    "svc/services/UserService.java": "package a;\nimport java.util.List;\npublic class UserService {\n    public int find(int id) {\n        return lookup(id);\n    }\n}\n",
    "api/routes.py": "@app.get('/x')\ndef list_orders():\n    pass\n",
    "controllers/a.py": "X = 1\n",
    "views/b.py": "def show():\n    pass\n",
    "models/c.py": "def build():\n    pass\n",
    "tests/test_store.py": "import pytest\n\n\ndef test_load():\n    pass\n",
    "config/settings.py": "def configure():\n    pass\n",
    "long/plain.txt": "\n".join(f"line {k}" for k in range(250)) + "\n",
    "long/body.py": "def first():\n" + "\n".join(f"    x{k} = {k}" for k in range(199)) + "\n",
    "odd/ends.py": "a = 1\r\ndef f():\r\n    pass" + chr(0x2028) + "class C:\n    pass",
    "README.md": "# Title\n\n![badge](x)\n\nA tool that\nkeeps orders.\n\nMore text.\n",
    "empty.py": "",
}
UNINDEXED = {
    "Dockerfile": "FROM x\n", "docker-compose.yml": "a: 1\n", "Makefile": "all:\n", ".github/workflows/ci.yml": "on: push\n", "requirements.txt": "# c\nflask>=2\npytest\nfoo~=1\n-r other\n",
    "package.json": '{"dependencies": {"react": "1", "left": "2"}, "devDependencies": {"jest": "3"}}', "go.mod": "module x\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.2\n)\n", "Gemfile": "gem 'rails'\n",
    "Cargo.toml": 'name = "x"\nserde = "1"\n', "pyproject.toml": 'dependencies = [\n "django>=4", "x"\n]\n',
}


def texts(spark, project="p"):
    return spark.createDataFrame([(project, k, v) for k, v in {**FILES, **UNINDEXED}.items()], "project_id string, rel_path string, text string")


def write(root):
    for name, text in {**FILES, **UNINDEXED}.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    (root / "node_modules/x").mkdir(parents=True)
    (root / "node_modules/x/i.js").write_text("function no() {}\n")
    (root / "bin.py").write_bytes(b"a\0b")
    (root / "pic.png").write_bytes(b"x")
    (root / "big.py").write_bytes(b"#" * 1_000_001)
    (root / ".env.example").write_text("A=1\n")
    (root / "link.py").symlink_to(root / "app/store.py")
