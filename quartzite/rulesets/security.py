"""Rules of the common web risks, for all languages or several; secrets beside provider keys; infrastructure and markup."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

TS, PY, GO, JAVA = ("typescript",), ("python",), ("go",), ("java",)


def _owasp(name: str, severity: str, effort: int, languages: tuple[str, ...], pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"owasp:{name}", severity, "Vulnerability", effort, languages, pattern, bad, good, **more)


_SQL = r"(?:SELECT |INSERT INTO |UPDATE |DELETE FROM |DROP TABLE |ALTER TABLE |CREATE TABLE )"
_SERVLET = r"request\.get(?:Parameter|Headers?|Cookies|QueryString|PathInfo|Reader|InputStream)\("
#: Rule ids, severities and minutes.
RULES = [
    _owasp("api-key-in-query-string", "Major", 10, (), r"(?i)[?&](api[_-]?key|apikey|access_token|token)=", "u = \"https://a/b?api_key=\" + k", "u = \"https://a/b?page=1\"", on="text", tests=False),
    _owasp("session-id-in-url", "Major", 10, (), r"(?i)[?&;](jsessionid|phpsessid|sessionid|session_id|sid)=", "u = \"/a;jsessionid=\" + s", "u = \"/a?side=1\"", on="text", tests=False),
    _owasp("jwt-uses-none-algorithm", "Blocker", 10, (), r"(?i)\balgorithms?['\"]?\s*[:=]\s*\[?\s*[\"']none[\"']|\"alg\"\s*:\s*[\"']none[\"']", "const o = { algorithm: \"none\" };", "const o = { algorithm: \"HS256\" };", on="text", tests=False),
    _owasp("logging-sensitive-data", "Major", 10, (), r"(?i)(?:console\.(?:log|info|warn|error|debug)|log(?:ger)?\.(?:trace|debug|info|warn|error|fatal|fine|severe)|logging\.\w+|e?println!|print!|fmt\.Print\w*|System\.out\.print\w*|\bprint\s*\()[^\n]*\b(?:password|passwd|pwd|ssn|social[_-]?security|credit[_-]?card|creditcard|cvv)\b", "console.error(user.password);", "console.error(user.name);", on="text", tests=False),
    _owasp("disabled-cert-validation", "Critical", 10, ("go", "python", "typescript"), r"rejectUnauthorized\s*[:=]\s*false|NODE_TLS_REJECT_UNAUTHORIZED|InsecureSkipVerify|ssl\._create_unverified_context|CERT_NONE|\bverify\s?=\s?False", "const o = { rejectUnauthorized: false };", "const o = { rejectUnauthorized: true };", on="text"),
    _owasp("dockerfile-root-user", "Critical", 10, ("dockerfile",), r"^\s*FROM\s", "FROM a:1\nRUN b", "FROM a:1\nUSER app\nRUN b", absent=r"^\s*USER\s", on="text"),
    _owasp("eval-usage", "Critical", 10, ("python", "typescript"), r"(?<![\w.$])(?:eval|Function)\(", "const a = eval(b);", "const a = evaluate(b);"),
    _owasp("command-execution", "Major", 15, TS, r"(?<![\w$])(?:\w+\.)?(?:exec|execSync|spawn|spawnSync)\(", "import { exec } from 'child_process';\nexec(a);", "const m = re.exec(a);", file="child_process", hotspot=True),
    _owasp("insecure-cookie-flags", "Major", 10, (), r"(?i)(?:set-cookie|\.cookie\s*\(|document\.cookie\s*=|cookie::new\s*\(|set_cookie\s*\()", "res.cookie(\"a\", b);", "res.cookie(\"a\", b, { httpOnly: true, secure: true, sameSite: \"lax\" });", on="text", unless=r"(?i)httponly.*secure|secure.*httponly", tests=False),
    _owasp("insecure-deserialization", "Critical", 10, ("java", "php", "python", "ruby"), r"pickle\.loads?\(|ObjectInputStream|readObject|Marshal\.load|unserialize\(|yaml\.load\((?![^\n]*(?:Loader=|safe_load))", "a = pickle.loads(b)", "a = json.loads(b)"),
    _owasp("insecure-file-permissions", "Critical", 10, ("go", "python", "typescript"), r"\b(?:fs\.chmod(?:Sync)?|os\.chmod|os\.Chmod)\([^\n]*\b(?:0o?)?777\b", "fs.chmodSync(a, 0o777);", "fs.chmodSync(a, 0o600);", tests=False),
    _owasp("insecure-random", "Critical", 10, ("python", "typescript"), r"\bMath\.random\b|(?<![\w.])random\.(?:random|randint|choice|randrange)\b", "const a = Math.random();", "const a = crypto.randomUUID();"),
    _owasp("nosql-injection", "Critical", 10, TS, r"\$(?:where|gt|ne|regex)\b[^\n]*(?:req\.(?:body|query)|request\.(?:args|json))", "db.find({ a: { $ne: req.body.a } });", "db.find({ a: String(b) });"),
    _owasp("open-redirect", "Major", 10, (), r"(?i)(?:res\.redirect|response\.redirect|HttpResponseRedirect|redirect_to|\bredirect)\s*\(\s*(?![\"'][^\"'\n]*[\"']\s*\))[^)\n]*(?:req\.|request\.|params\.|query\.|\$_get|\$_post|\$_request)", "res.redirect(req.query.next);", "res.redirect(\"/home\");", on="text"),
    _owasp("path-traversal-java", "Blocker", 10, JAVA, r"\b(?:FileInputStream|FileOutputStream|FileReader|FileWriter|RandomAccessFile)\b", "String n = request.getParameter(\"a\");\nnew FileReader(n);", "new FileReader(\"a.txt\");", file=_SERVLET),
    _owasp("xss-java", "Blocker", 10, JAVA, r"\.getWriter\(\)\.(?:write|print|println|format|append)\(", "String n = request.getParameter(\"a\");\nresponse.getWriter().print(n);", "response.getWriter().print(\"a\");", file=_SERVLET),
    _owasp("permissive-cors", "Major", 10, (), r"(?:Access-Control-Allow-Origin|origin\s?[:=]|CORS\()[^\n]*(?:'\*'|\"\*\"|origin: true)", "const o = { origin: '*' };", "const o = { origin: 'https://a.b' };", on="text"),
    _owasp("post-message-wildcard", "Critical", 10, TS, r"\bpostMessage\([^,\n]+,\s*[\"'`]\*[\"'`]", "w.postMessage(a, '*');", "w.postMessage(a, origin);", on="text", tests=False),
    _owasp("prototype-pollution", "Critical", 10, TS, r"(?:Object\.assign|merge\(|extend\(|deepMerge)[^\n]*(?:__proto__|constructor\.prototype)|(?:__proto__|constructor\.prototype)[^\n]*(?:Object\.assign|merge\(|extend\(|deepMerge)", "Object.assign(a.__proto__, b);", "Object.assign(a, b);", on="text"),
    _owasp("sql-injection-concat", "Critical", 10, (), rf"(?i)[\"'`][^\"'`\n]*{_SQL}[^\n]*(?:[\"']\s*\+|\$\{{)|(?<![\w])f[\"'][^\n]*{_SQL}[^\n]*\{{|(?i:sprintf|format!)\([^\n]*{_SQL}[^\n]*(?:%[sd]|\{{\}})", "q = \"SELECT a FROM b WHERE c = \" + d;", "q = \"SELECT a FROM b WHERE c = ?\";", on="text", tests=False),
    _owasp("timing-attack-comparison", "Major", 10, (*TS, *PY, "rust"), r"\b\w*(?:token|apiKey|api_key|secret|hash|signature)\w*\s*={2,3}|={2,3}\s*[\w.]*(?:token|apiKey|api_key|secret|hash|signature)\b", "if (req.signature === expected) { a(); }", "if (crypto.timingSafeEqual(signature, b)) { a(); }", unless="timingSafeEqual|constant_time"),
    _owasp("unverified-jwt", "Critical", 10, ("python", "typescript"), r"\bjwt\.(?:decode|verify)\([^\n]*(?:verify\s*=\s*False|verify_signature[\"']?\s*:\s*False|ignoreExpiration\s*:\s*true)|\bjwt\.decode\([^,)\n]*\)", "const a = jwt.decode(b);", "const a = jwt.verify(b, key);", tests=False),
    _owasp("weak-crypto", "Critical", 10, ("rust",), r"\b(?:Md5|MD5|md5|Sha1|SHA1|sha1|RC4|Rc4)(?:::|\()", "fn f() { let a = Md5::new(); }", "fn f() { let a = Sha256::new(); }", tests=False),
    _owasp("weak-crypto-hash", "Critical", 10, ("python", "typescript", "rust"), r"(?i)createhash\(\s*[\"'](?:md5|sha-?1)[\"']|hashlib\.(?:md5|sha1)\b|cryptojs\.(?:md5|sha1)\b", "const a = crypto.createHash(\"md5\");", "const a = crypto.createHash(\"sha256\");", on="text", tests=False),
    _owasp("hardcoded-secret", "Critical", 10, (), r"(?i)\b\w*(?:password|passwd|secret|api_?key|auth_?token)\w*[\"']?\s*(?::=|[:=])\s*[\"'][^\"'\s$<{]{8,}[\"']", "password = \"hunter2hunter2\"", "password = os.environ[\"P\"]", on="text", tests=False),
    _owasp("cors-all-origins-and-credentials", "Critical", 10, (), r"(?i)credentials['\"]?\s*[:=]\s*true", "const o = { origin: \"*\", credentials: true };", "const o = { origin: \"https://a.b\", credentials: true };", file=r"(?:origin['\"]?\s*[:=]\s*|Access-Control-Allow-Origin[^\n]*)[\"']\*[\"']", on="text"),
    CodeRule("a11y:img-missing-alt", "Major", "CodeSmell", 10, ("html",), r"(?i)<img(?=[\s/>])(?![^>]*\balt\s*=)[^>]*>?", "<img src=\"a\">", "<img src=\"a\" alt=\"b\">", on="text"),
    CodeRule("a11y:missing-lang-attribute", "Minor", "CodeSmell", 10, ("html",), r"(?i)<html(?=[\s>])(?![^>]*lang=)[^>]*>", "<html>\n</html>", "<html lang=\"en\">\n</html>", on="text"),
    CodeRule("iac:iam-wildcard-permission", "Major", "Vulnerability", 20, ("hcl", "json", "yaml"), r"(?i)\"(?:action|resource)\":\s?\"\*\"|\b(?:actions|resources)\s?=\s?\[\"\*\"\]|\b(?:resources|verbs): \[\"\*\"\]", "actions = [\"*\"]", "actions = [\"s3:Get\"]", on="text"),
    CodeRule("iac:open-ingress-cidr", "Critical", "Vulnerability", 15, ("hcl", "json", "yaml"), r"(?i)(?:cidr|ingress)[^\n]*0\.0\.0\.0/0|0\.0\.0\.0/0[^\n]*(?:cidr|ingress)", "cidr_blocks = [\"0.0.0.0/0\"]", "cidr_blocks = [\"10.0.0.0/8\"]", on="text"),
    CodeRule("secrets:dotenv-file-committed", "Major", "Vulnerability", 10, (), r"\A", "A=1", "A=1", path=r"(^|/)\.env(\.(?!example$|sample$|template$)[\w.]+)?$", at=("d{}/.env", "d{}/.env.example")),
    CodeRule("secrets:secret-in-log-message", "Major", "Vulnerability", 10, (), r"(?i)(?:console\.\w+|log(?:ger)?\.\w+|logging\.\w+|println!|\bprint)\s*\([^\n]*\b(?:secret|token|api_?key|private_?key)\b", "logger.info(\"key\", api_key)", "logger.info(\"done\", count)", on="text", tests=False),
    CodeRule("ai-agent:no-dynamic-reflection", "Major", "Vulnerability", 15, ("python", "typescript"), r"(?<![\w.$])(?:eval|exec)\(\s*(?![\"'`\s)])|\b(?:getattr|setattr|delattr)\(\s*[^,\n]+,\s*(?![\"'\s])|\bReflect\.(?:get|set)\(\s*[^,\n]+,\s*(?![\"'`\s])", "const a = Reflect.get(b, name);", "const a = Reflect.get(b, \"name\");"),
    CodeRule("architecture:folder-naming-casing", "Major", "CodeSmell", 10, (), r"\A", "a", "a", path=r"^(?!src/|node_modules/|target/|\.)(?=[^/]*[A-Z])(?=[^/]*_)[^/]+/", at=("Bad_Name/f{}.go", "good-name/f{}.go")),
    CodeRule("smells:todo-comment", "Info", "CodeSmell", 10, (), r"(?://|#|/\*|\*)[^\n]*\b(?:TODO|FIXME|XXX|HACK)\b", "// TODO: a", "// done: a", on="text", unless="^$"),
    CodeRule("smells:select-star", "Minor", "CodeSmell", 10, (), r"(?i)\bselect\s+\*\s+from\b", "q = \"SELECT * FROM a\"", "q = \"SELECT b FROM a\"", on="text"),
    CodeRule("smells:commented-out-code", "Minor", "CodeSmell", 10, (), r"^\s*(?://|#)\s*(?:(?:const|let|var|return|if|for|while|import|def|fn|func)\b[^\n]*[;{)(:]|[\w.]+\([^\n]*\);)\s*$", "// const a = b();", "// a is b, see the docs", on="text", unless="^$"),
    CodeRule("go:context-value-string-key", "Major", "Bug", 10, GO, r"\bcontext\.WithValue\([^,\n]+,\s*[\"`]", "ctx := context.WithValue(a, \"k\", b)", "ctx := context.WithValue(a, key, b)"),
    CodeRule("go:sql-injection-concat", "Blocker", "Vulnerability", 20, GO, r"\.(?:Query|QueryContext|QueryRow|QueryRowContext|Exec|ExecContext|Prepare|PrepareContext)\([^\n]*(?:[\"`]\s*\+|\+\s*[\"`]|fmt\.Sprintf\()", "rows := db.Query(\"a\" + b)", "rows := db.Query(\"a\", b)"),
    CodeRule("go:unchecked-type-assertion", "Major", "Bug", 10, GO, r"^(?!\s*\w+\s*,\s*\w+\s*:?=)(?!\s*(?:switch|case)\b)[^\n]*\.\((?!type\))\*?[\w.]+\)", "a := b.(string)", "a, ok := b.(string)"),
    CodeRule("go:weak-random-token", "Critical", "Vulnerability", 10, GO, r"(?i)\b\w*(?:token|password|passwd|secret|apikey|session)\w*\s*:?=[^\n]*rand\.(?:Intn?|Int63n?|Int31n?|Float64|Float32|Perm|Shuffle|NormFloat64|ExpFloat64)\(", "token := rand.Intn(9)", "index := rand.Intn(9)"),
    CodeRule("go:defer-in-loop", "Major", "CodeSmell", 15, GO, r"\bfor\b[^{\n]*\{(?:(?!\bfunc\b)[^{}])*\bdefer\b", "for i := range a {\n  defer f.Close()\n}", "for i := range a {\n  f.Close()\n}"),
    CodeRule("go:goroutine-loop-var-capture", "Major", "Bug", 10, GO, r"\bfor\s+(\w+)\s*:=[^{\n]*\{[^}]*\bgo\s+func\(\)\s*\{[^}]*\b\1\b", "for i := 0; i < 3; i++ {\n  go func() { f(i) }()\n}", "for i := 0; i < 3; i++ {\n  go func(j int) { f(j) }(i)\n}", hotspot=True),
    CodeRule("mutation:arithmetic-operator", "Info", "CodeSmell", 10, ("rust", "go", "java", "typescript"), r"[\w)\]]\s*(?<![+\-*/])[+\-*/](?![+\-*/=>])\s*[\w(]", "let a = b + c;", "let a = b;"),
    CodeRule("mutation:boolean-inversion", "Info", "CodeSmell", 10, ("rust", "go", "java", "typescript"), r"\bif\b[^{\n]*(?:&&|\|\|)", "if (a && b) { c(); }", "if (a) { c(); }"),
    CodeRule("mutation:conditional-boundary", "Info", "CodeSmell", 10, ("rust", "go", "java", "typescript"), r"[\w)\]]\s*(?:>=|<=)\s*[\w(]", "if (a >= b) { c(); }", "if (a === b) { c(); }"),
    CodeRule("mutation:return-value-substitution", "Info", "CodeSmell", 10, ("rust", "go", "java", "typescript"), r"\breturn\s+(?!;)\S", "function f() { return a; }", "function f() { return; }"),
    CodeRule("mutation:void-call-deletion", "Info", "CodeSmell", 10, ("rust", "go", "java", "typescript"), r"^\s*(?!if\b|for\b|while\b|switch\b|return\b|catch\b|function\b)[\w.:$]+\([^{}\n]*\)\s*;\s*$", "save(a);", "const b = save(a);"),
]
