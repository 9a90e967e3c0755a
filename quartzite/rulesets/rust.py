"""Rules for Rust. Rules on panics leave out files that hold a test module."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

RS = ("rust",)
_PRIMITIVES = "bool|i8|u8|i16|u16|i32|u32|i64|u64|isize|usize"
_FS = r"\bfs::(?:write|remove_file|remove_dir_all|remove_dir|create_dir_all|create_dir|rename|copy|set_permissions|hard_link)"


def _rs(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"rust:{name}", severity, kind, effort, RS, pattern, bad, good, **more)


#: Rule ids, severities and minutes.
RULES = [
    _rs("dbg-macro", "Minor", "CodeSmell", 2, r"\bdbg!\s*\(", "fn f() { dbg!(a); }", "fn f() { log!(a); }"),
    _rs("box-leak", "Major", "Bug", 10, r"\bBox::leak\s*\(", "fn f() { let a = Box::leak(b); }", "fn f() { let a = Box::new(b); }", hotspot=True),
    _rs("mem-forget", "Major", "Bug", 10, r"\bmem::forget\s*\(", "fn f() { std::mem::forget(a); }", "fn f() { std::mem::drop(a); }", hotspot=True),
    _rs("mem-transmute", "Critical", "Bug", 20, r"\bmem::transmute\s*(?:::<[^>\n]*>+)?\s*\(", "fn f() { let a = mem::transmute::<u8, i8>(b); }", "fn f() { let a = b as i8; }", hotspot=True),
    _rs("mem-uninit-or-zeroed", "Critical", "Bug", 20, r"\bmem::(?:uninitialized|zeroed)\s*(?:::<[^>\n]*>+)?\s*\(", "fn f() { let a = mem::zeroed(); }", "fn f() { let a = MaybeUninit::uninit(); }", hotspot=True),
    _rs("process-exit", "Minor", "CodeSmell", 10, r"\bprocess::(?:exit|abort)\s*\(", "fn f() { std::process::exit(1); }", "fn f() -> ExitCode { a }"),
    _rs("static-mut", "Major", "Bug", 20, r"\bstatic\s+mut\s", "static mut A: u8 = 1;", "static A: AtomicU8 = b;"),
    _rs("modulo-one", "Major", "Bug", 5, r"%\s*1(?![\w.])", "fn f() { a % 1 }", "fn f() { a % 10 }"),
    _rs("float-literal-eq", "Major", "Bug", 10, r"[=!]=\s*-?\d+\.\d+|(?<![\w.])\d+\.\d+\s*[=!]=", "fn f() { if a == 0.1 { b } }", "fn f() { if a == 1 { b } }"),
    _rs("self-comparison", "Major", "Bug", 10, r"(?<![\w.:\])])([A-Za-z_][\w.]*)\s*(?:==|!=|<=|>=|<|>)\s*\1(?![\w.(\[:])", "fn f() { if a.b == a.b { c } }", "fn f() { if a.b == a.c { d } }"),
    _rs("disallow-unwrap-expect", "Major", "CodeSmell", 10, r"\.(?:unwrap|expect)\s*\(", "fn f() { a.unwrap(); }", "fn f() { a.unwrap_or(b); }", absent=r"#\[cfg\(test\)\]", off_path=r"tests/|_test\.rs"),
    CodeRule("smells:unwrap-usage", "Major", "Bug", 10, RS, r"\.unwrap\s*\(\s*\)", "fn f() { a.unwrap(); }", "fn f() { a?; }", absent=r"#\[cfg\(test\)\]", tests=False),
    _rs("disallow-panic-macros", "Major", "CodeSmell", 5, r"\b(?:panic|todo|unimplemented)!\s*[(\[{]", "fn f() { panic!(a); }", "fn f() { assert!(a); }", absent=r"#\[cfg\(test\)\]|#\[test\]", off_path=r"tests/|benches/|examples/|_tests?\.rs$"),
    _rs("drop-on-reference", "Major", "Bug", 10, r"(?<![.\w])(?:\w+::)*drop\(\s*&", "fn f() { drop(&a); }", "fn f() { drop(a); }"),
    _rs("from-over-into", "Minor", "CodeSmell", 10, r"^\s*impl\b[^{\n]*\bInto<[^{\n]*\bfor\b", "impl Into<A> for B { }", "impl From<A> for B { }"),
    _rs("missing-result-handling", "Major", "Bug", 5, rf"^\s*(?:\w+::)*{_FS}\([^;\n]*\)\s*;", "fn f() {\n    std::fs::write(a, b);\n}", "fn f() {\n    std::fs::write(a, b)?;\n}"),
    _rs("mutex-atomic-candidate", "Minor", "CodeSmell", 15, rf"\b(?:Mutex|RwLock)<\s*(?:{_PRIMITIVES})\s*>", "struct A { b: Mutex<bool> }", "struct A { b: Mutex<Vec<bool>> }"),
    _rs("rc-used-in-multithread-context", "Major", "Bug", 10, r"\b(?:thread|tokio|task|rayon)::spawn\([^;]*?(?<!A)\bRc(?:::new\(|<)", "fn f() { thread::spawn(g(Rc::new(a))); }", "fn f() { thread::spawn(g(Arc::new(a))); }"),
    _rs("blocking-sleep-in-async", "Major", "Bug", 10, r"\basync\s+fn\s+\w+[^{;]*\{[^}]*\bthread::sleep\s*\(", "async fn f() {\n    std::thread::sleep(a);\n}", "fn f() {\n    std::thread::sleep(a);\n}"),
    _rs("blocking-io-in-async", "Major", "Bug", 10, r"\basync\s+fn\s+\w+[^{;]*\{[^}]*(?<!tokio::)(?<!async_std::)\bfs::(?:read|read_to_string|read_dir|write|remove_file|remove_dir|create_dir|create_dir_all|rename|copy|metadata|File::open|File::create)\s*\(", "async fn f() {\n    let a = std::fs::read(b);\n}", "async fn f() {\n    let a = tokio::fs::read(b).await;\n}"),
    _rs("lock-held-across-await", "Critical", "Bug", 15, r"\blet\s+(?:mut\s+)?(\w+)\s*=\s*[^;]*\.lock\(\)(?![^;]*\.await)[^;]*;(?![^}]*\bdrop\(\s*\1\s*\)[^}]*\.await)[^}]*\.await\b", "async fn f() {\n    let g = m.lock().unwrap();\n    h().await;\n}", "async fn f() {\n    let g = m.lock().await;\n    drop(g);\n}"),
    _rs("env-var-read-in-library-code", "Minor", "CodeSmell", 15, r"\benv::var(?:_os)?\s*\(", "fn load() { let a = env::var(b); }", "fn load() { let a = env::args(); }", absent=r"\bfn\s+(?:main|(?:try_)?from_env(?:_os)?)\b"),
    _rs("format-string-runtime-constructed", "Major", "CodeSmell", 10, r"\b(?:format|print|println|eprint|eprintln)!\(\s*(?![\"\s)]|concat!|r#*\")[A-Za-z_]", "fn f() { println!(a); }", "fn f() { println!(\"{}\", a); }"),
    _rs("derive-clone-on-large-struct", "Minor", "CodeSmell", 15, r"#\[derive\([^)\n]*\bClone\b[^)\n]*\)\]\s*(?:#\[[^\]\n]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?struct\s+\w+[^{;]*\{(?:[^{}]*?\w\s*:\s*[^,{}]+,){10}", "#[derive(Clone)]\nstruct A { a: u8, b: u8, c: u8, d: u8, e: u8, f: u8, g: u8, h: u8, i: u8, j: u8, }", "#[derive(Clone)]\nstruct A { a: u8, b: u8, }"),
    _rs("derive-hash-manual-partial-eq", "Major", "Bug", 20, r"#\[derive\([^)\n]*\bHash\b[^)\n]*\)\]\s*(?:pub\s+)?(?:struct|enum)\s+(\w+)(?=(?s:.)*\bimpl\s+PartialEq\s+for\s+\1\b)", "#[derive(Hash)]\nstruct A { b: u8 }\nimpl PartialEq for A { }", "#[derive(Hash, PartialEq)]\nstruct A { b: u8 }"),
    _rs("almost-swapped", "Critical", "Bug", 5, r"^\s*([\w.\[\]]+)\s*=\s*([\w.\[\]]+)\s*;\s*\2\s*=\s*\1\s*;", "fn f() {\n    a = b;\n    b = a;\n}", "fn f() {\n    a = b;\n    b = c;\n}"),
    _rs("absurd-extreme-comparison", "Major", "Bug", 5, r"\b(\w+)\s*:\s*u(?:8|16|32|64|128|size)\b[^{;]*\{[^}]*(?<![\w.])\1\s*(?:<|>=)\s*0(?![\w.])", "fn f(a: u8) { if a < 0 { b } }", "fn f(a: i8) { if a < 0 { b } }"),
    _rs("panic-in-drop", "Critical", "Bug", 15, r"\bimpl\b[^{\n]*\bDrop\s+for\b[^{]*\{\s*fn\s+drop\([^)]*\)\s*\{[^}]*(?:\b(?:panic|todo|unimplemented|unreachable|(?:debug_)?assert(?:_eq|_ne)?)!|\.(?:unwrap|expect)\()", "impl Drop for A {\n    fn drop(&mut self) { b.unwrap(); }\n}", "impl Drop for A {\n    fn drop(&mut self) { b.ok(); }\n}"),
    _rs("mutex-locked-in-drop", "Major", "Bug", 15, r"\bimpl\b[^{\n]*\bDrop\s+for\b[^{]*\{\s*fn\s+drop\([^)]*\)\s*\{[^}]*\.(?:lock|read|write)\(", "impl Drop for A {\n    fn drop(&mut self) { let g = self.m.lock(); }\n}", "impl Drop for A {\n    fn drop(&mut self) { let g = self.m.get(); }\n}"),
    _rs("unsafe-send-sync-impl", "Critical", "Bug", 20, r"(?<!SAFETY[^\n]{0,300}\n)^\s*unsafe\s+impl\b[^{\n]*\b(?:Send|Sync)\s+for\b", "unsafe impl Send for A {}", "// SAFETY: A owns its data\nunsafe impl Send for A {}", on="text", unless="^$", hotspot=True),
    _rs("unsafe-undocumented", "Major", "Bug", 10, r"(?<!SAFETY[^\n]{0,300}\n)^[^\n/]*\bunsafe\s*\{", "fn f() {\n    let a = unsafe { *b };\n}", "fn f() {\n    // SAFETY: b is valid\n    let a = unsafe { *b };\n}", on="text", unless="^$", hotspot=True),
    _rs("unsafe-block-leaks-abstraction", "Major", "Bug", 20, r"^\s*pub\s+(?!unsafe\b)(?:const\s+|async\s+)?fn\s+\w+[^{;]*\*(?:mut|const)\s[^{;]*\{", "pub fn f(a: *mut u8) { b }", "pub unsafe fn f(a: *mut u8) { b }", hotspot=True),
    _rs("missing-doc-on-public-item", "Minor", "CodeSmell", 5, r"(?<!(?:///|//!|\*/|#\[doc)[^\n]{0,300}\n)(?<!\#\[[^\n]{0,200}\n)^pub\s+(?:(?:async|unsafe|const)\s+)*(?:fn|struct|enum|trait)\s+\w+", "fn a() {}\n\npub fn f() { b }", "/// Says b.\npub fn f() { b }", on="text", unless="^$"),
    _rs("unused-lifetime-parameter", "Minor", "CodeSmell", 5, r"\bfn\s+\w+<\s*'(\w+)\s*>(?![^{;]*'\1\b)", "fn f<'a>(b: &str) { c }", "fn f<'a>(b: &'a str) { c }"),
    _rs("typeshare-dto-sync", "Major", "Bug", 5, r"#\[typeshare\b[^\n]*\]\s*(?!(?:#\[[^\n]*\]\s*)*#\[serde\([^\n]*rename_all)(?:#\[(?!serde\([^\n]*rename_all)[^\n]*\]\s*)*(?:pub\s+)?struct\b", "#[typeshare]\npub struct A { b: u8 }", "#[typeshare]\n#[serde(rename_all = \"camelCase\")]\npub struct A { b: u8 }", on="text", unless="^$"),
    _rs("suspicious-arithmetic-impl", "Major", "Bug", 10, r"\bimpl\b[^{\n]*\bAdd(?:<[^>\n]*>)?\s+for\b[^{]*\{(?:[^{}]*)\bfn\s+add\([^)]*\)[^{]*\{[^+}]*[-*/%][^+}]*\}", "impl Add for A {\n    fn add(self, o: A) -> A { A(self.0 - o.0) }\n}", "impl Add for A {\n    fn add(self, o: A) -> A { A(self.0 + o.0) }\n}"),
    _rs("clippy-analyzer", "Major", "CodeSmell", 10, r"^\s*(?:pub\s+)?use\s+[^;]*\*", "use a::*;", "use a::b;"),
    CodeRule("naming:rust-convention", "Minor", "CodeSmell", 10, RS, r"\b(?:struct|enum|trait)\s+(?![A-Z][A-Za-z0-9]*\b)\w+|\bfn\s+(?![a-z_][a-z0-9_]*\b)\w+", "struct bad_name { a: u8 }", "struct GoodName { a: u8 }"),
]
