"""Templates: verdicts per name, the markup's states, cycles and deep chains."""

import time

import pytest

from flowfacts.frontend import markup
from flowfacts.frontend.templates import verdicts

GOOD = [
    "{% load static i18n %}<p title=\"{{ name }}\">{% trans 'Hello' %} {{ name|upper }}</p>\n<a href=\"/users/{{ name }}/\">{{ name }}</a> <a href='https://example.com/?q={{ name }}'>x</a>\n",
    "<img src=\"{% static 'logo.png' %}\" alt=\"{{ name }}\"><!-- {{ name }} --><title>{{ name }}</title>",
    "{% for item in items %}{{ item }}{% empty %}-{% endfor %}{% comment %}{{ x|safe }}{% endcomment %}{# {{ x|safe }} #}",
    "<script>var a = '<p title=\"';</script>{{ name }}", "<div class=a title='x'>{{ name|default:'|safe' }}</div>", "",
]
WRONG = [
    "{{ name|safe }}", "{{ items|safeseq|join:', ' }}", "{% autoescape off %}{{ name }}{% endautoescape %}", "<script>var n = '{{ name }}';</script>", "<style>p { color: {{ color }} }</style>", "<a href=\"{{ url }}\">x</a>",
    "<a href=\"javascript:go('{{ name }}')\">x</a>", "<div onclick=\"go('{{ name }}')\">x</div>", "<div style=\"width: {{ width }}\">x</div>", "<div title={{ name }}>x</div>", "<div {{ attributes }}>x</div>", "<div data-{{ x }}=\"a\">x</div>",
    "{% load custom_tags %}<p>{{ name }}</p>", "{% custom_tag name %}", "{% include template_name %}", "{% extends base_name %}", "{% include 'app/missing.html' %}", "{{ name|unheard_of }}", None,
]


def found(spark, files):
    return {r.name: r.escapes for r in verdicts(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}


def test_single_templates(spark):
    files = {f"app/templates/good{k}.html": t for k, t in enumerate(GOOD)} | {f"app/templates/wrong{k}.html": t for k, t in enumerate(WRONG)} | {"app/other/page.html": "{{ x }}"}
    got = found(spark, files)
    assert [n for n, e in got.items() if e != n.startswith("good")] == [] and len(got) == len(GOOD) + len(WRONG)


def test_what_a_template_extends_and_includes_counts(spark):
    files = {
        "a/templates/base.html": "{% load static %}<html>{% block content %}{% endblock %}<script src=\"{% static 'app.js' %}\"></script>",
        "a/templates/page.html": "{% extends 'base.html' %}{% block content %}<p>{{ name }}</p>{% include 'part.html' %}{% endblock %}{{ x|safe }}",
        "a/templates/part.html": "<span>{{ name }}</span>",
        "a/templates/raw.html": "{% block content %}{% endblock %}<p>{{ name|safe }}</p>",
        "a/templates/on_raw.html": "{% extends 'raw.html' %}{% block content %}{{ name }}{% endblock %}",
        "a/templates/code.html": "<script>{% block code %}{% endblock %}</script>{% block rest %}{{ x|safe }}{% endblock %}",
        "a/templates/in_code.html": "{% extends 'code.html' %}{% block code %}{{ name }}{% endblock %}{% block rest %}{% endblock %}",
        "a/templates/over.html": "{% extends 'code.html' %}{% block rest %}{{ name }}{% endblock %}",
        "a/templates/super.html": "{% extends 'over.html' %}{% block rest %}{{ block.super }}<i>{{ y }}</i>{% endblock %}",
        "a/templates/super_raw.html": "{% extends 'code.html' %}{% block rest %}{{ block.super }}{% endblock %}",
        "a/templates/opens.html": "<script>", "a/templates/after.html": "{% include 'opens.html' %}{{ name }}", "a/templates/closed.html": "{% include 'opens.html' %}</script>{{ name }}",
        "a/templates/quoted.html": "<p title=\"{% include 'part2.html' %}\">", "a/templates/part2.html": "{{ name }}", "a/templates/address.html": "<a href=\"{% include 'part2.html' %}\">",
        "one/templates/twice.html": "<p>{{ name }}</p>", "two/templates/twice.html": "<p>{{ name|safe }}</p>", "a/templates/uses_twice.html": "{% include 'twice.html' %}",
        "a/templates/self.html": "{% extends 'self.html' %}", "a/templates/lost.html": "{% extends 'nowhere.html' %}",
    }
    got = found(spark, files)
    assert {n for n, e in got.items() if e} == {"base.html", "page.html", "part.html", "over.html", "super.html", "opens.html", "closed.html", "quoted.html", "part2.html"}
    assert set(found(spark, files | {"site/settings.py": "TEMPLATES = [{'OPTIONS': {'autoescape': False}}]\n"}).values()) == {False}


@pytest.mark.parametrize("end, escapes", [("{{ x }}", True), ("{{ x|safe }}", False)])
def test_doubled_includes_and_cycles_end(spark, end, escapes):
    files = {f"t/templates/l{k}.html": f"{{% include 'l{k + 1}.html' %}}{{% include 'l{k + 1}.html' %}}" for k in range(20)} | {"t/templates/l20.html": "{% if a %}{% include 'l0.html' %}{% endif %}" + end}
    files |= {f"t/templates/c{k}.html": "".join(f"{{% if a %}}{{% include 'c{j}.html' %}}{{% endif %}}" for j in range(40)) + (end if k == 7 else "{{ y }}") for k in range(40)}
    files |= {f"t/templates/e{k}.html": f"{{% extends 'e{k + 1}.html' %}}{{% block b %}}{{{{ block.super }}}}{{{{ block.super }}}}{{% endblock %}}" for k in range(12)} | {"t/templates/e12.html": "{% block b %}" + end + "{% endblock %}"}
    began = time.time()
    assert set(found(spark, files).values()) == {escapes}
    print("seconds", time.time() - began)


def test_states_do_not_depend_on_where_text_is_cut():
    whole = "<a class='x' href=\"/u?q=1\" onclick=\"f()\">b<!-- c > --><script>if (a<b) {}</script><title>t</title><p a=b c>"
    at = [markup.moved(0, whole[:k]) for k in range(len(whole) + 1)]
    for k in range(1, len(whole) + 1):
        if whole[k - 1] in " >\"'(u1" and "name" not in markup.STATES[at[k]] and whole[k - 3 : k - 1] != "--":
            assert markup.moved(at[k], whole[k:]) == at[-1], (k, whole[:k], markup.STATES[at[k]])
