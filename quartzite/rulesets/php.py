"""Rules for PHP and for WordPress code."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule

PHP = ("php",)
_INPUT = r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)"
_CLEAN = r"sanitize_\w+|esc_\w+|absint|intval|floatval|boolval|wp_kses\w*|wp_json_encode|isset|empty"


def _php(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"php:{name}", severity, kind, effort, PHP, pattern, bad, good, **more)


def _wp(name: str, severity: str, kind: str, effort: int, pattern: str, bad: str, good: str, **more) -> CodeRule:
    return CodeRule(f"wordpress:{name}", severity, kind, effort, PHP, pattern, bad, good, **more)


#: Rule ids, severities and minutes; names of functions, constants and globals.
RULES = [
    _php("command-execution", "Major", "Vulnerability", 15, r"(?<![\w>:$])(?:system|exec|shell_exec|passthru|popen|proc_open|pcntl_exec)\s*\(", "<?php exec($a);", "<?php $b->exec_all($a);", hotspot=True),
    _php("eval-usage", "Critical", "Vulnerability", 20, r"(?<![\w>:$])eval\s*\(", "<?php eval($a);", "<?php evaluate($a);", hotspot=True),
    _php("extract-usage", "Critical", "Vulnerability", 20, r"(?<![\w>:$])extract\s*\(", "<?php extract($a);", "<?php $b->extract($a);", hotspot=True),
    _php("error-suppression-operator", "Minor", "CodeSmell", 10, r"(?:^|[=(,;{\s])@\s*[\w$\\]+", "<?php $a = @file($b);", "<?php $a = file($b);"),
    _php("loose-hash-comparison", "Critical", "Vulnerability", 15, r"(?<![\w>:$])(?:md5|sha1|hash|crc32)\([^()\n]*\)\s*[=!]=(?!=)|(?<![=!])[=!]=(?!=)\s*(?:md5|sha1|hash|crc32)\(", "<?php if (md5($a) == $b) { c(); }", "<?php if (md5($a) === $b) { c(); }"),
    _php("dynamic-function-call-from-superglobal", "Blocker", "Vulnerability", 25, r"(?:call_user_func(?:_array)?|forward_static_call)\(\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES|ENV)|\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES|ENV)\[[^\]\n]*\]\s*\(", "<?php call_user_func($_GET['a']);", "<?php call_user_func($a);", hotspot=True),
    _php("variable-variable", "Major", "CodeSmell", 10, r"(?<!\$)\$\$\w+|\$\{\s*\$", "<?php $$a = 1;", "<?php $a = 1;"),
    _php("sql-injection-concat", "Blocker", "Vulnerability", 20, r"(?:(?:mysqli_query|mysql_query|pg_query|pg_exec|sqlite_query|sqlite_exec)\(|\$\w+->(?:query|exec|prepare)\()[^;\n]*(?:[\"']\s*\.|\.\s*\$)", "<?php $db->query(\"a\" . $b);", "<?php $db->query(\"a\", $b);"),
    _php("swallowed-exception", "Major", "Bug", 15, r"\bcatch\s*\([^)\n]*\)\s*\{\s*(?:error_log\([^()]*(?:\([^()]*\))?[^()]*\)\s*;?\s*)*\}", "<?php try { a(); } catch (E $e) { }", "<?php try { a(); } catch (E $e) { throw $e; }"),
    _php("weak-random-token", "Critical", "Vulnerability", 10, r"(?i)\$\w*(?:token|password|passwd|secret|apikey|session)\w*\s*=(?!=)[^\n]*\b(?:rand|mt_rand|uniqid)\(", "<?php $token = mt_rand();", "<?php $index = mt_rand();"),
    _wp("assignment-in-condition", "Major", "Bug", 5, r"\b(?:else\s*)?if\s*\(\s*\$[\w\[\]>'\"-]+\s*=(?![=>])", "<?php if ($a = b()) { c(); }", "<?php if ($a == b()) { c(); }"),
    _wp("discouraged-constant", "Minor", "CodeSmell", 5, r"(?<![\w$])(?:TEMPLATEPATH|STYLESHEETPATH)\b", "<?php include TEMPLATEPATH . 'a';", "<?php include get_template_directory() . 'a';"),
    _wp("discouraged-function", "Major", "CodeSmell", 10, r"(?<![\w>:$])(?:query_posts|get_currentuserinfo|like_escape|attribute_escape|wp_specialchars|js_escape|clean_url|create_function)\s*\(", "<?php query_posts($a);", "<?php new WP_Query($a);"),
    _wp("global-variable-override", "Major", "Bug", 15, r"\$GLOBALS\[\s*['\"](?:post|wpdb|wp_query|wp_the_query|wp|wp_rewrite|current_user|wp_object_cache|table_prefix|wp_customize|wp_scripts|wp_styles|wp_locale|wp_filesystem)['\"]\s*\]\s*=(?!=)", "<?php $GLOBALS['post'] = $a;", "<?php $GLOBALS['mine'] = $a;", on="text"),
    _wp("i18n-missing-text-domain", "Minor", "CodeSmell", 5, r"(?<![\w>:$])(?:__|_e|esc_html__|esc_html_e|esc_attr__|esc_attr_e)\(\s*(?:'[^'\n]*'|\"[^\"\n]*\")\s*\)", "<?php echo __('a');", "<?php echo __('a', 'b');", on="text"),
    _wp("unversioned-enqueued-resource", "Minor", "CodeSmell", 5, r"(?<![\w>:$])wp_(?:enqueue|register)_(?:script|style)\(\s*[^,()\n]+,\s*[^,\n]+(?:,\s*(?:array\([^()\n]*\)|\[[^\]\n]*\]|[^,()\n]+))?\s*(?:,\s*false\s*(?:,[^\n]*)?)?\)\s*;", "<?php wp_enqueue_script('a', $b, array());", "<?php wp_enqueue_script('a', $b, array(), '1.2');", on="text"),
    _wp("nonce-verification-missing", "Major", "Vulnerability", 20, r"\$_(?:POST|GET|REQUEST)\b", "<?php function f() { save($_POST['a']); }", "<?php function f() { check_admin_referer('b'); save($_POST['a']); }", absent=r"wp_verify_nonce|check_admin_referer|check_ajax_referer", hotspot=True),
    _wp("unescaped-superglobal-output", "Blocker", "Vulnerability", 15, rf"\b(?:echo|print)\b(?![^;\n]*\b(?:{_CLEAN})\s*\()[^;\n]*{_INPUT}", "<?php echo $_GET['a'];", "<?php echo esc_html($_GET['a']);"),
    _wp("unprepared-wpdb-query", "Blocker", "Vulnerability", 20, r"\$wpdb->(?:get_results|get_var|get_col|get_row)\((?![^;\n]*->prepare\()[^;\n]*(?:[\"']\s*\.|\.\s*\$|\"[^\"\n]*\$\w)", "<?php $wpdb->get_var(\"a\" . $b);", "<?php $wpdb->get_var($wpdb->prepare(\"a\", $b));", on="text"),
    _wp("unsafe-plugin-menu-slug", "Major", "Vulnerability", 15, r"(?<![\w>:$])add_(?:menu|options|management|theme|plugins|users|dashboard|posts|media|links|comments)_page\([^;\n]*__FILE__", "<?php add_menu_page('a', 'b', 'c', __FILE__);", "<?php add_menu_page('a', 'b', 'c', 'd');"),
    _wp("unsanitized-superglobal-input", "Major", "Vulnerability", 15, rf"\$\w+\s*=(?![=>])(?![^;\n]*\b(?:{_CLEAN})\s*\()[^;\n]*{_INPUT}", "<?php $a = $_POST['b'];", "<?php $a = sanitize_text_field($_POST['b']);"),
]
