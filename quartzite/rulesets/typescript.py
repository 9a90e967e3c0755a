"""Rules for TypeScript and JavaScript."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

TS = ("typescript",)
_SECRETS = "token|password|passwd|secret|apikey|session"


def _ts(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"typescript:{name}", severity, kind, effort, TS, pattern, bad, good, **more)


#: Rule ids, severities and minutes.
RULES = [
    _ts("innerhtml-assignment", "Critical", "Vulnerability", 10, r"\.innerHTML\s*=(?!=)", "el.innerHTML = x;", "if (el.innerHTML == x) { a(); }", hotspot=True),
    _ts("loose-equality", "Minor", "CodeSmell", 2, r"(?<![=!<>])[=!]=(?!=)", "if (a == b) { c(); }", "if (a === b || c !== d || e <= f) { g(\"a == b\"); }"),
    _ts("no-explicit-any", "Major", "CodeSmell", 10, r":[ \t]*any\b|(?<!\w)as[ \t]+any\b|<any>", "const a = b as any;", "const many: company = anyOf(x); // as any"),
    _ts("leftover-debug-statement", "Minor", "CodeSmell", 2, r"^\s*debugger\b|\bconsole\.(log|debug)\s*\(", "console.log(a);", "console.error(a); // console.log(b)", tests=False),
    _ts("math-random-for-token", "Critical", "Vulnerability", 10, rf"(?i)[\w.$]*({_SECRETS})[\w$]*\s*(:[^=\n]+)?=(?!=)[^\n]*math\.random\(", "const sessionToken = Math.random().toString(36);", "const jitter = Math.random();"),
    _ts("dynamic-regexp-source", "Major", "Vulnerability", 10, r"(?<![\w.$])RegExp\(\s*(?![\"'`)\s])", "const r = new RegExp(input);", "const r = new RegExp(\"a+\");"),
    _ts("buffer-noassert", "Critical", "Vulnerability", 10, r"\.(read|write)(U?Int8|U?Int(16|32)(LE|BE)|(Float|Double)(LE|BE))\([^)\n]*\btrue\b", "buf.readUInt16LE(0, true);", "buf.readUInt16LE(0);"),
    _ts("negated-ternary-condition", "Minor", "CodeSmell", 2, r"(=|\(|,|\breturn\b|:)\s*!(?!=)[\w.$()\[\]]+\s*\?(?![.?])[^:?\n]+:", "const a = !b ? c : d;", "const a = b ? !c : d;"),
    _ts("nested-ternary", "Major", "CodeSmell", 10, r"\?(?![.?:])[^?:;\n]*:[^?;\n]*\?(?![.?:])[^?;\n]*:|\?(?![.?:])[^?:;\n]*\?(?![.?:])[^?:;\n]*:[^?;\n]*:", "const a = b ? c : d ? e : f;", "const a = b ? c : d?.e;"),
    _ts("prefer-array-at", "Minor", "CodeSmell", 2, r"([\w$.]+)\[\s*\1\.length\s*-\s*[1-9]\d*\s*\]", "const l = a.b[a.b.length - 1];", "const l = a[b.length - 1];"),
    _ts("prefer-globalthis-over-window", "Minor", "CodeSmell", 2, r"(?<![\w.$])window(?![\w$]|\s*:)", "window.alert(1);", "a.window = myWindow;"),
    _ts("prefer-regexp-exec", "Minor", "CodeSmell", 5, r"\.match\(\s*/[^/\n]+/(?![a-z]*g)[a-z]*\s*\)", "const m = a.match(/b+/i);", "const m = a.match(/b+/g);"),
    _ts("prefer-replaceall", "Minor", "CodeSmell", 2, r"\.replace\(\s*/[^/\n]+/[a-z]*g", "a.replace(/b/g, c);", "a.replace(/b/i, c);"),
    _ts("redos-nested-quantifier", "Major", "Vulnerability", 10, r"/[^/\n]*\([^()\n]*[+*][^()\n]*\)[+*][^/\n]*/", "const r = /(a+)+b/;", "const r = /(ab)+c*/;"),
    _ts("redundant-type-alias", "Minor", "CodeSmell", 2, r"^\s*(?:export\s+)?type\s+(\w+)\s*=\s*(?!(?:string|number|boolean|bigint|any|unknown|never|object|symbol|void|undefined|null|\1)\b)[A-Za-z_]\w*\s*;?\s*$", "type A = B;", "type A = B | C;"),
    _ts("type-alias-overused-for-naming-only", "Info", "CodeSmell", 10, r"^\s*(?:export\s+)?type\s+\w+\s*=\s*(?:string|number|boolean|bigint)\s*;?\s*$", "type Id = string;", "type Id = string & Brand;"),
    _ts("redundant-type-assertion", "Minor", "CodeSmell", 2, r"\bas\s+(\w+)\s*\)?\s+as\s+\1\b", "const a = (b as C) as C;", "const a = (b as C) as D;"),
    _ts("sensitive-data-in-web-storage", "Critical", "Vulnerability", 10, rf"(localStorage|sessionStorage)\.setItem\(\s*[\"'`][^\"'`\n]*(?i:{_SECRETS}|auth)", "localStorage.setItem(\"authToken\", t);", "localStorage.setItem(\"theme\", t);", on="text", hotspot=True),
    _ts("sort-without-compare", "Major", "Bug", 10, r"\.sort\(\s*\)", "a.sort();", "a.sort((x, y) => x - y);"),
    _ts("ts-ignore-without-justification", "Major", "CodeSmell", 3, r"//\s*@ts-(ignore|expect-error)[: \t]*$", "// @ts-ignore\na();", "// @ts-ignore: the types are wrong upstream\na();", on="text", unless="^$"),
    _ts("var-declaration", "Minor", "CodeSmell", 2, r"(?<![\w.$])var\s+[\w$\[{]", "var a = 1;", "let variable = 1;"),
    _ts("optional-chaining-on-definite-values", "Info", "CodeSmell", 2, r"(?<![\w.$])this\?\.|\bnew\s+\w+\([^)\n]*\)\)?\?\.", "this?.a();", "that?.a();"),
    _ts("open-redirect-location-assignment", "Critical", "Vulnerability", 10, r"(?<![\w.$])((window|document|self|globalThis)\.)?location(\.href)?\s*=(?!=)\s*(?![\"'`\s])\S", "window.location.href = next;", "window.location.href = \"/home\";", hotspot=True),
    _ts("implicit-any-on-rest-params", "Major", "CodeSmell", 3, r"[(,]\s*\.\.\.\w+\s*\)\s*(:[^={\n]+)?(\{|=>)", "function f(a: string, ...rest) { g(); }", "function f(...rest: string[]) { g(...rest); }"),
    _ts("mass-assignment-from-request-body", "Critical", "Vulnerability", 10, r"Object\.assign\([^,\n]+,[^\n]*\breq\.(body|query|params)|\{[^}\n]*\.\.\.\s*req\.(body|query|params)", "Object.assign(user, req.body);", "Object.assign(user, pick(body));"),
    _ts("namespace-usage-in-module-code", "Minor", "CodeSmell", 15, r"^\s*(export\s+)?namespace\s+\w+", "import a from 'b';\nnamespace C { }", "namespace C { }", file=r"^\s*(import|export)\b"),
    _ts("non-null-assertion-overuse", "Major", "CodeSmell", 10, r"[\w)\]]!\.\w+!\.\w+!", "const x = a!.b!.c!;", "const x = a!.b!.c;"),
    _ts("promise-then-without-catch", "Major", "Bug", 10, r"^\s*(?!return\b|await\b)[\w.$]+(\([^()\n]*\))?\.then\((?:[^(),\n]|\([^()\n]*\))*\)\s*;?\s*$", "load(a).then(b);", "load(a).then(b).catch(c);\nawait load(a).then(b);"),
    _ts("promise-return-type-mismatch", "Major", "Bug", 5, r"\basync\b[^{=;\n]*\)\s*:\s*(?![^{=;\n]*Promise)[\w<>\[\]| .]+(\{|=>)", "async function f(a): string { return b; }", "async function f(a): Promise<string> { return b; }"),
    _ts("swallowed-exception", "Major", "Bug", 15, r"\bcatch\s*(\([^)\n]*\))?\s*\{\s*(console\.\w+\([^()]*\)\s*;?\s*)*\}", "try { a(); } catch (e) {\n}", "try { a(); } catch (e) {\n  throw e;\n}"),
    _ts("broad-catch-with-unknown-error-type", "Major", "Bug", 10, r"\bcatch\s*\(\s*(\w+)\s*\)\s*\{(?![^{}]*\b(?:instanceof|typeof)\b)[^{}]*\b\1\.(message|stack|name)\b", "try { a(); } catch (e) {\n  show(e.message);\n}", "try { a(); } catch (e) {\n  if (e instanceof Error) show(e.message);\n}"),
    _ts("missing-exhaustive-switch", "Minor", "CodeSmell", 5, r"\bswitch\s*\([^{}\n]*\)\s*\{(?![^{}]*(?:\{[^{}]*\}[^{}]*){0,400}\bdefault\s*:)", "switch (a) {\n  case 1: b();\n}", "switch (a) {\n  case 1: b(); break;\n  default: c();\n}"),
    _ts("index-signature-overuse", "Minor", "CodeSmell", 10, r"\b(interface\s+\w+[^{;=\n]*|type\s+\w+\s*=\s*)\{(?=[^{}]*\[\s*\w+\s*:\s*(?:string|number|symbol)\s*\]\s*:)(?=[^{}]*(?:^|[;,{])\s*(?:readonly\s+)?\w+\??\s*:)", "interface A { [key: string]: B; name: C; }", "interface A { [key: string]: B; }"),
    _ts("enum-stringly-typed", "Minor", "CodeSmell", 10, r"\benum\s+\w+\s*\{\s*(?:(\w+)\s*=\s*[\"'`]\1[\"'`]\s*,?\s*)+\}", "enum A { B = \"B\", C = \"C\" }", "enum A { B = \"b\", C = \"C\" }", on="text"),
    _ts("unknown-not-narrowed-before-use", "Major", "Bug", 10, r"[(,]\s*(\w+)\s*:\s*unknown\b[^{;]*\{(?![^{}]*(?:instanceof|typeof| in ))[^{}]*\b\1\.\w+", "function f(a: unknown) { return a.b; }", "function f(a: unknown) { if (typeof a === 'string') return a.b; }"),
    _ts("prefer-default-parameters", "Minor", "CodeSmell", 2, r"\((?=[^()\n]*\b(\w+)\b)[^()\n]*\)[^{}\n]*\{\s*(\w+)\s*=\s*\2\s*(\?\?|\|\|)", "function f(a) {\n  a = a || 1;\n}", "function f(a = 1) {\n  b = a || 1;\n}"),
    _ts("type-level-logic-too-complex", "Major", "CodeSmell", 20, r"\btype\s+\w+(?:<[^=;]*>)?\s*=(?:[^;]*?\bextends\b[^;?]*\?){3}", "type A<T> = T extends B ? T extends C ? T extends D ? 1 : 2 : 3 : 4;", "type A<T> = T extends B ? 1 : 2;"),
    _ts("implicit-any-return-in-arrow-function", "Minor", "CodeSmell", 5, r"^\s*export\s+const\s+\w+\s*=\s*(?:async\s*)?\(\s*(?:\w+\s*(?:,\s*\w+\s*)*)?\)\s*=>", "export const f = (a, b) => a;", "export const f = (a: string): string => a;"),
    CodeRule("naming:boolean-prefix", "Minor", "CodeSmell", 10, TS, r"\b(?:const|let|var)\s+(?!is|has|should|can)\w+\s*(?::\s*boolean\b|=\s*(?:true|false)\s*;?\s*$)", "const open = true;", "const isOpen = true;\nconst open: string = a;"),
    CodeRule("naming:event-handler-prefix", "Minor", "CodeSmell", 10, TS, r"\b(?!handle)\w+(?:Handler|_handler)\b", "const clickHandler = a;", "const handleClickHandler = a;"),
    CodeRule("reactive:missing-unsubscribe", "Major", "Bug", 10, TS, r"[\w.$]+\s*=(?!=)[^\n]*\.subscribe\(", "const s = a.subscribe(b);", "const s = a.subscribe(b);\ns.unsubscribe();", unless=r"takeUntil\(", absent=r"\.unsubscribe\("),
    CodeRule("reactive:subject-never-completed", "Minor", "CodeSmell", 10, TS, r"=\s*new\s+(?:Behavior|Replay|Async)?Subject\b", "const s = new Subject();", "const s = new Subject();\ns.complete();", absent=r"\.complete\("),
    CodeRule("ai-agent:no-wildcard-reexports", "Major", "CodeSmell", 5, TS, r"^\s*export\s+\*\s+from\b", "export * from './a';", "export { a } from './a';", path=r"(^|/)index\.[jt]sx?$", at=("b/c{}/index.ts", "b/c{}/index.ts")),
    CodeRule("vite-react:tailwind-space-between", "Minor", "CodeSmell", 10, TS, r"className=[\"'{`][^\n>]*\bspace-[xy]-", "const a = <div className=\"space-x-2\" />;", "const a = <div className=\"gap-2\" />;", on="text", tests=False),
    CodeRule("vite-react:transport-client-outside-infra", "Blocker", "CodeSmell", 10, TS, r"\baxios\.create\(|\bnew\s+Axios\(", "const c = axios.create();", "const c = create();", off_path=r"(^|/)(infra|infrastructure|api|lib)/", tests=False),
    CodeRule("vite-react:hardcoded-base-url", "Major", "CodeSmell", 10, TS, r"(?i)\b(?:url|endpoint|\w*(?:base|api|server|backend)\w*url)\s*[:=]\s*[\"'`]https?://", "const API_URL = \"https://a.b\";", "const API_URL = import.meta.env.API;", on="text", tests=False),
    CodeRule("vite-react:no-transport-call-in-view", "Blocker", "CodeSmell", 10, TS, r"(?<![\w.$])fetch\(|\baxios(?:\.(?:get|post|put|patch|delete|head|options|request))?\(", "const a = fetch(b);", "const a = load(b);", path=r"\.(tsx|jsx)$", tests=False, at=("b/View{}.tsx", "b/View{}.tsx")),
]
