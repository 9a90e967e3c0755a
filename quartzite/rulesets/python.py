"""Rules for Python that a pattern states best, and for domain code of several languages; the others are filters on syntax nodes."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

PY, TS = ("python",), ("typescript",)
_CLOSES = r"wait|communicate|terminate|kill"
_MUTABLE = r"(?:\[|\{|list\(|dict\(|set\()"
_DOMAIN = r"(^|/)(domains?|entit(y|ies)|aggregates?|value[-_]?objects|core)/"


def _py(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"python:{name}", severity, kind, effort, PY, pattern, bad, good, **more)


#: Rule ids, severities and minutes.
RULES = [
    _py("celery-task-missing-timeout", "Minor", "Bug", 10, r"^\s*@(?:\w+\.)*(?:shared_task|\w+\.task)\b(?![^\n]*(?:soft_)?time_limit\s*=)", "@app.task\ndef f(): pass", "@app.task(time_limit=9)\ndef f(): pass"),
    _py("global-mutable-singleton", "Major", "CodeSmell", 30, rf"^([A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*{_MUTABLE}(?=(?s:.)*^\s+global\s+(?:\w+\s*,\s*)*\1\b)", "cache = {}\ndef f():\n    global cache\n    cache = {}\n", "cache = {}\ndef f():\n    return cache\n"),
    _py("modern-type-syntax", "Minor", "CodeSmell", 5, r"\bfrom\s+typing\s+import\b[^\n]*\b(?:List|Dict|Optional|Union)\b|\btyping\.(?:List|Dict|Optional|Union)\b", "from typing import List", "from typing import Any"),
    _py("mutable-default-in-dataclass-field", "Major", "Bug", 10, rf"@(?:\w+\.)*dataclass\b[^\n]*\n(?:@[^\n]*\n)*class\b[^\n]*:\s*\n(?:[ \t]+[^\n]*\n|[ \t]*\n){{0,400}}?[ \t]+\w+\s*:\s*[^=\n]+=\s*{_MUTABLE}", "@dataclass\nclass A:\n    b: list = []\n", "@dataclass\nclass A:\n    b: list = field(default_factory=list)\n"),
    _py("numpy-float-comparison-eq", "Major", "CodeSmell", 10, r"\b(?:np|numpy)\.float(?:32|64)\([^()\n]*\)\s*[=!]=|[=!]=\s*(?:np|numpy)\.float(?:32|64)\(|\b(?:np|numpy)\.(?:as)?array\([^\n]*(?:dtype[^\n)]*(?:float|f4|f8)|\d\.\d)[^\n]*\)\s*[=!]=", "if np.float64(a) == b: pass", "if np.isclose(a, b): pass"),
    _py("pandas-chained-assignment", "Major", "Bug", 10, r"^\s*[\w.]+\[[^\]\n]*\]\[\s*[\"'][^\n]*\]\s*=(?!=)", "import pandas as pd\ndf[a]['b'] = 1\n", "import pandas as pd\ndf.loc[a, 'b'] = 1\n", file="pandas", on="text"),
    _py("missing-context-manager-for-resource", "Major", "CodeSmell", 10, r"^\s*\w+\s*=\s*(?:socket\.socket|sqlite3\.connect|psycopg2\.connect|pymysql\.connect|MySQLdb\.connect)\(", "c = sqlite3.connect(a)", "with sqlite3.connect(a) as c: pass"),
    _py("subprocess-popen-without-close", "Major", "Bug", 10, rf"^\s*(\w+)\s*=\s*subprocess\.Popen\((?!(?s:.)*\b\1\.(?:{_CLOSES})\()(?!(?s:.)*^\s*return\b[^\n]*\b\1\b)", "p = subprocess.Popen(a)\nb()\n", "p = subprocess.Popen(a)\np.wait()\n"),
    _py("temporary-file-with-static-name", "Major", "Vulnerability", 10, r"(?<![\w.])open\(\s*[\"'](?:/tmp/|/var/tmp/|/dev/shm/|(?i:c:\\\\temp\\\\|c:\\\\windows\\\\temp\\\\))", "f = open('/tmp/a', 'w')", "f = open('a', 'w')", on="text", tests=False),
    _py("unsafe-random-module-for-security", "Critical", "Vulnerability", 10, r"(?i)^\s*[\w.]*(?:token|password|passwd|secret|api_?key|otp|nonce|salt|csrf)\w*\s*=(?!=)[^\n]*(?<![\w.])random\.(?:random|randint|choice|choices|randrange|sample|getrandbits|uniform)\(", "token = random.randint(1, 9)", "index = random.randint(1, 9)"),
    _py("flask-secret-key-hardcoded", "Critical", "Vulnerability", 10, r"(?:\.secret_key|\[\s*[\"']SECRET_KEY[\"']\s*\])\s*=\s*[\"'][^\"'\n]+[\"']", "app.secret_key = 'abc'", "app.secret_key = os.environ['K']", on="text"),
    _py("ruff-analyzer", "Major", "CodeSmell", 10, r"^\s*(?:def|class|if|for|while|with|elif|else|try|except|finally)\b[^\n:#]*(?<![,(\[{\\:])$(?![^\n]*:)", "def f()\n    pass\n", "def f():\n    pass\n", unless=r"[(\[{,\\]\s*$"),
    CodeRule("ddd:domain-jargon-naming", "Minor", "CodeSmell", 15, (), r"\b(?:class|interface|struct|type|enum)\s+(?:\w+(?:Dto|DTO|Dao|DAO|Pojo|POJO)\b|(?:Db|Sql|Orm)\w+)", "class OrderDto { }", "class Order { }", path=_DOMAIN, at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("ddd:public-entity-setter", "Major", "CodeSmell", 30, TS, r"^\s*(?:public\s+)?(?:set\s+\w+|set[A-Z_]\w*)\s*\([^)\n]*\)[^;\n]*\{", "class A {\n  setName(n) { this.n = n; }\n}", "class A {\n  private setName(n) { this.n = n; }\n  settle(n) { }\n}", path=_DOMAIN, at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("ddd:persistence-in-domain", "Minor", "CodeSmell", 60, TS, r"^\s*@(?:Entity|Table|Column|PrimaryGeneratedColumn|PrimaryColumn|ManyToOne|OneToMany|ManyToMany|OneToOne|JoinColumn|JoinTable|Schema|Prop|Model|ForeignKey|BelongsTo|HasMany|Property)\b", "@Entity()\nclass A { }", "@Injectable()\nclass A { }", path=_DOMAIN, at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("ddd:repository-per-entity", "Major", "CodeSmell", 10, TS, r"\b(?:class|interface)\s+\w*(?:Line|Item|Detail|Row|Entry)Repository\b", "class OrderItemRepository { }", "class OrderRepository { }"),
    CodeRule("ddd:primitive-obsession", "Minor", "CodeSmell", 60, TS, r"\bfunction\s+\w+\s*\((?:\s*\w+\??\s*:\s*(?:string|number|boolean)\s*,){2,}\s*\w+\??\s*:\s*(?:string|number|boolean)\s*[,)]", "function f(a: string, b: string, c: number) { }", "function f(a: string, b: Money) { }", path=_DOMAIN, at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("ddd:aggregate-exposes-internal-collection", "Major", "CodeSmell", 30, TS, r"\bget\s+(\w+)\s*\(\s*\)[^{\n]*(?:\[\]|Array<|Set<|Map<|List<)[^{\n]*\{\s*return\s+this\._?\w+\s*;?\s*\}", "class A { get items(): Item[] { return this._items; } }", "class A { get items(): Item[] { return [...this._items]; } }", path=_DOMAIN, at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("architecture:framework-in-domain", "Major", "CodeSmell", 45, TS, r"\bfrom\s+[\"'](?:express|axios|typeorm|mongoose|sequelize|pg|mysql2?|redis|ioredis|fastify|koa|@nestjs/\w+|@prisma/client|aws-sdk|@aws-sdk/[\w-]+|(?:node:)?fs(?:/promises)?|(?:node:)?https?)[\"'/]", "import x from 'express';", "import x from './money';", on="text", path=r"(^|/)(domains?|application|ports?|usecases?|use[-_]cases)/", at=("src/domain/a{}.ts", "src/domain/a{}.ts")),
    CodeRule("architecture:cross-slice-coupling", "Major", "CodeSmell", 10, TS, r"\bfrom\s+[\"'][^\"'\n]*(?:features|slices)/[\w-]+/internal/", "import x from '../features/cart/internal/y';", "import x from '../features/cart';", on="text"),
    CodeRule("vite-react:data-hook-outside-api-dir", "Major", "CodeSmell", 10, TS, r"\b(?:useQuery|useMutation|useInfiniteQuery)\s*(?:<[^>\n]*>)?\(", "import { useQuery } from '@tanstack/react-query';\nconst a = useQuery(b);", "const a = useQuery(b);", file=r"from\s+[\"'](?:@tanstack/)?react-query[\"']", off_path=r"(^|/)api/", tests=False),
    CodeRule("vite-react:no-data-layer-import-in-view", "Blocker", "CodeSmell", 20, TS, r"\bimport\s*\{[^}\n]*\b(?:useQuery|useMutation|useInfiniteQuery|useQueries)\b[^}\n]*\}\s*from\s+[\"'](?:@tanstack/)?react-query[\"']|\bfrom\s+[\"']axios[\"']", "import { useQuery } from '@tanstack/react-query';", "import { useCart } from '../api/cart';", on="text", path=r"(^|/)(components|pages|views)/", off_path=r"(^|/)stores?/", at=("src/components/A{}.tsx", "src/components/A{}.tsx"), tests=False),
    CodeRule("smells:service-locator", "Major", "CodeSmell", 30, TS, r"(?<![\w.$])[A-Z]\w*\.(?:getInstance|getDefault)\(\s*\)|\b\w*(?:Locator|Container|Registry|Injector)\.(?:get|resolve|lookup|make|inject)\(", "const a = ServiceLocator.get(b);", "const a = new Map().get(b);"),
    CodeRule("smells:type-check-chain", "Major", "CodeSmell", 45, TS, r"\bif\s*\(\s*(\w+)\s+instanceof\b[^{\n]*\{[^{}]*\}\s*else\s+if\s*\(\s*\1\s+instanceof\b", "if (a instanceof B) { c(); } else if (a instanceof D) { e(); }", "if (a instanceof B) { c(); } else { e(); }"),
    CodeRule("smells:constructor-over-injection", "Major", "CodeSmell", 60, TS, r"\bconstructor\s*\((?:\s*(?:(?:private|public|protected|readonly)\s+)*\w+\s*:\s*(?!string|number|boolean)(?!\w*(?:Config|Configuration|Settings|Options|Params|Args)\b)[A-Z]\w*(?:<[^>]*>)?\s*,){4,}\s*(?:(?:private|public|protected|readonly)\s+)*\w+\s*:\s*[A-Z]", "class A { constructor(a: B, c: D, e: F, g: H, i: J) { } }", "class A { constructor(a: B, c: D, e: F) { } }"),
    CodeRule("smells:concrete-dependency", "Major", "CodeSmell", 10, TS, r"\bconstructor\s*\([^)]*\)\s*\{[^}]*\bthis\.\w+\s*=\s*new\s+[A-Z]\w*(?:Service|Repository|Client|Gateway|Store|Manager|Provider)\(", "class A { constructor() { this.b = new OrderRepository(); } }", "class A { constructor(b) { this.b = b; } }"),
    CodeRule("smells:liskov-not-implemented", "Major", "CodeSmell", 10, (), r"(?:throw\s+new\s+(?:Error|NotImplementedError|UnsupportedOperationException)\(\s*[\"'][^\"'\n]*(?i:not (?:implemented|supported))|\braise\s+NotImplementedError\b)", "class A extends B { f() { throw new Error('not implemented'); } }", "class A extends B { f() { return 1; } }", on="text", file=r"\bextends\b|class\s+\w+\(\s*\w"),
]
