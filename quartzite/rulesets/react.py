"""Rules for React components."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

TS = ("typescript",)


def _react(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"react:{name}", severity, kind, effort, TS, pattern, bad, good, **more)


_HEX = r"#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})"
#: Rule ids, severities and minutes.
RULES = [
    _react("dangerously-set-inner-html", "Critical", "Vulnerability", 10, r"\bdangerouslySetInnerHTML\s*=", "const a = <p dangerouslySetInnerHTML={b} />;", "const a = <p>{b}</p>;", hotspot=True),
    _react("auth-token-in-web-storage", "Major", "Vulnerability", 10, r"(?i)(?:localStorage|sessionStorage)\.setItem\([^\n]*(?:token|bearer|session|secret|auth|jwt)", "sessionStorage.setItem('jwt', a);", "sessionStorage.setItem('size', a);", on="text"),
    _react("jsx-no-script-url", "Critical", "Vulnerability", 10, r"(?i)[\"'`]javascript:", "const a = <a href=\"javascript:b()\" />;", "const a = <a href=\"/b\" />;", on="text"),
    _react("unsafe-target-blank", "Major", "Vulnerability", 10, r"<a\b(?![^>]*rel=[\"'{][^>]*(?:noopener|noreferrer))[^>]*target=[\"']_blank[\"']", "const a = <a href={b} target=\"_blank\">c</a>;", "const a = <a href={b} target=\"_blank\" rel=\"noopener\">c</a>;", on="text"),
    _react("jsx-img-missing-alt", "Major", "CodeSmell", 10, r"<img\b(?![^>]*\balt\b)[^>]*>", "const a = <img src={b} />;", "const a = <img src={b} alt=\"c\" />;"),
    _react("no-children-prop", "Minor", "CodeSmell", 10, r"<[\w.]+\b[^>\n]*\schildren=", "const a = <A children={b} />;", "const a = <A>{b}</A>;"),
    _react("no-default-export", "Minor", "CodeSmell", 10, r"^\s*export\s+default\b", "export default A;", "export const A = b;"),
    _react("lazy-state-init", "Major", "CodeSmell", 10, r"\buseState(?:<[^>\n]*>)?\(\s*[\w.$]+\([^\n]*\)\s*\)", "const [a, setA] = useState(load());", "const [a, setA] = useState(() => load());"),
    _react("jsx-ternary-null", "Minor", "CodeSmell", 10, r"\?(?![.?])\s*\(?\s*<[^?;{}]*>\s*\)?\s*:\s*null\b|\?(?![.?])\s*null\s*:\s*\(?\s*<", "const a = b ? <C /> : null;", "const a = b ? <C /> : <D />;"),
    _react("hook-missing-deps-array", "Major", "Bug", 10, r"\b(?:React\.)?use(?:Effect|LayoutEffect|Memo|Callback)\(\s*(?:async\s*)?(?:\([^()\n]*\)|\w+)\s*=>\s*(?:\{[^{}]*\}|[^{}(),;\n]+(?:\([^()\n]*\))?)\s*\)", "useEffect(() => { a(); });", "useEffect(() => { a(); }, [b]);"),
    _react("no-fetch-in-useeffect", "Major", "CodeSmell", 10, r"\b(?:React\.)?useEffect\(\s*(?:async\s*)?\([^()\n]*\)\s*=>\s*\{[^}]*(?:\bfetch\(|\baxios[.(])", "useEffect(() => {\n  fetch(a);\n}, []);", "useEffect(() => {\n  b(a);\n}, []);"),
    _react("no-useless-memo", "Minor", "CodeSmell", 10, r"\buse(?:Memo|Callback)\(\s*\(\)\s*=>\s*(?:\d+|true|false|null|[\"'`]{2}|\[\s*\]|\(?\{\s*\}\)?)\s*[,)]", "const a = useMemo(() => 1, []);", "const a = useMemo(() => b(c), [c]);"),
    _react("no-useless-fragment", "Minor", "CodeSmell", 10, r"<>\s*<(\w+)\b[^<>]*(?:/>|>[^<>]*</\1>)\s*</>", "const a = <><B /></>;", "const a = <><B /><C /></>;"),
    _react("context-provider-value-memo", "Major", "CodeSmell", 10, r"<[\w.]*Provider\b[^>\n]*\svalue=\{\s*[\[{]", "const a = <C.Provider value={{ b }} />;", "const a = <C.Provider value={b} />;"),
    _react("css-absolute-text-unit", "Minor", "CodeSmell", 10, r"\b(?:fontSize|lineHeight)\s*:\s*[\"'`]-?\d[^\"'`\n]*px[\"'`]|\b(?:text|leading)-\[-?\d[\d.]*px\]", "const a = <p style={{ fontSize: '12px' }} />;", "const a = <p style={{ fontSize: '1rem' }} />;", on="text"),
    _react("css-hardcoded-hex-color", "Minor", "CodeSmell", 10, rf"\b(?:color|background|backgroundColor|borderColor|fill|stroke)\s*:\s*[\"'`]{_HEX}[\"'`]|\b(?:bg|text|border|fill|stroke|ring|shadow)-\[#", "const a = <p style={{ color: '#ff0000' }} />;", "const a = <p style={{ color: 'var(--a)' }} />;", on="text"),
    _react("css-svh-viewport-unit", "Minor", "CodeSmell", 10, r"\d[\d.]*svh\b", "const a = <p style={{ height: '100svh' }} />;", "const a = <p style={{ height: '100dvh' }} />;", on="text"),
    _react("i18n-hardcoded-fallback", "Minor", "CodeSmell", 10, r"(?<![\w.$])(?:i18n\.)?t\(\s*[\"'][^\"'\n]+[\"']\s*,\s*[\"']", "const a = t('b.c', 'Fallback');", "const a = t('b.c', { d });", on="text", tests=False),
    _react("i18n-dynamic-t-outside-component", "Minor", "CodeSmell", 10, r"(?<![\w.$])i18n\.t\(\s*(?![\"'`\s)])", "const a = i18n.t(key);", "const a = i18n.t('key');", absent=r"<[A-Za-z][^<>\n]*/?>", tests=False),
    _react("zustand-fresh-selector", "Major", "CodeSmell", 10, r"\buse\w*Store\(\s*\(?\w+\)?\s*=>\s*(?:\(\s*\{|\[)", "const a = useCartStore((s) => ({ b: s.b }));", "const a = useCartStore((s) => s.b);", unless="useShallow"),
    _react("array-index-key", "Major", "Bug", 10, r"\.map\(\s*\(\s*\w+\s*,\s*(\w+)[^)\n]*\)\s*=>[^;]*?\bkey=\{\s*(?:String\(\s*)?\1\b", "const a = b.map((c, i) => <D key={i} />);", "const a = b.map((c, i) => <D key={c.id} />);"),
    _react("missing-list-key", "Major", "Bug", 10, r"\.map\(\s*\(?[^()=]*\)?\s*=>\s*\(?\s*<(?!>)[\w.]+(?![^>]*\bkey=)[^>]*>", "const a = b.map((c) => <D e={c} />);", "const a = b.map((c) => <D key={c} />);"),
    _react("no-static-element-interactions", "Major", "CodeSmell", 10, r"<(?!(?:a|button|input|select|textarea|option|label|form|audio|video|details|summary|dialog|menuitem)\b)[a-z]\w*\b(?![^>]*\brole=)[^>]*\son(?:Click|MouseDown|MouseUp|KeyDown|KeyUp|KeyPress)=", "const a = <div onClick={b} />;", "const a = <button onClick={b} />;"),
    _react("inline-prop-function-in-component", "Minor", "CodeSmell", 5, r"<[A-Z][\w.]*\b[^>\n]*\s(?!style=|key=|ref=)\w+=\{\s*(?:\([^()\n]*\)|\w+)\s*=>", "const a = <B onPick={() => c()} />;", "const a = <B onPick={c} />;", tests=False),
    _react("no-unstable-default-props", "Major", "CodeSmell", 10, r"\b(?:function|const)\s+[A-Z]\w*\s*(?:=\s*)?\(\s*\{[^}\n]*=\s*(?:\[\]|\{\})", "function A({ b = [] }) { return c; }", "function a({ b = [] }) { return c; }"),
    _react("direct-state-mutation", "Critical", "Bug", 10, r"\[\s*(\w+)\s*,\s*set\w+\s*\]\s*=\s*(?:React\.)?use(?:State|Reducer)\b(?s:.)*?\b\1\.(?:push|pop|shift|unshift|splice|sort|reverse|fill|copyWithin)\(", "const [a, setA] = useState([]);\na.push(1);", "const [a, setA] = useState([]);\nsetA([...a, 1]);"),
    _react("unused-state", "Minor", "CodeSmell", 10, r"\[\s*(\w+)\s*,\s*set\w+\s*\]\s*=\s*(?:React\.)?useState\b(?!(?s:.)*\b\1\b)", "const [a, setA] = useState(1);\nsetA(2);", "const [a, setA] = useState(1);\nshow(a);"),
    _react("no-async-client-component", "Major", "CodeSmell", 10, r"\basync\s+function\s+[A-Z]\w*|\bconst\s+[A-Z]\w*\s*=\s*async\b", "'use client';\nasync function A() { return b; }", "async function A() { return b; }", file=r"[\"']use client[\"']"),
    _react("feature-directory-isolation", "Major", "CodeSmell", 10, r"\bfrom\s+[\"'][^\"'\n]*features/\w+/[^\"'\n]+[\"']", "import { a } from '@/features/b/c';", "import { a } from '@/features/b';", on="text"),
    _react("bulletproof-folder-structure", "Major", "CodeSmell", 10, r"\A", "const a = 1;", "const a = 1;", at=("src/stray{}.ts", "src/b/stray{}.ts"), path=r"^src/(?!(?:index|main)\.tsx?$|App\.tsx?$|vite-env\.d\.ts$|setupTests\.ts$|react-app-env\.d\.ts$)[^/]+$"),
    CodeRule("naming:component-pascal-case", "Minor", "CodeSmell", 10, TS, r"\A", "const a = 1;", "const a = 1;", at=("b/user-card{}.tsx", "b/UserCard{}.tsx"), path=r"(^|/)(?!index\.tsx$|App\.tsx$)(?![A-Z][A-Za-z0-9]*\.tsx$)[^/]+\.tsx$"),
]
