"""The kernels over MUMPS source on one small routine, beside the rows that the rules of the language ask for.

The listed rows are output that was read through line by line against those rules, so they guard against changes. The same kernels run over whole tables in ``routine_queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mumps, mutants

SOURCE = """RTN ;first remark
EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X'=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y
 S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X
 F  S X=$O(^G(X)) Q:X=""  D
 . S Y=$G(^H(X,2)),Z=^(3)
 . S X=Y
 Q $$F(X,Y)
SUB(P,Q) ;;data; line
 ;only a comment
 R P:5 S ^G(P,1)=Q K ^H(Q) D T^OTHER
 Q
F(U,V) Q U_V_"a;""b"
"""


def _routine(s):
    return s.createDataFrame([("RTN", SOURCE)], "name string, source string")


def _joined(df, *columns):
    return df.select(*[F.array_join(c, ",").alias(c) if c in columns else F.col(c) for c in df.columns])


QUERIES = {
    "golden_mutants": lambda s, d: mutants.mutants(_routine(s)).where("line <= 7").select("operator", "line", "detail", "difficulty", "may_hang", F.coalesce("mutated_line", F.lit("(dropped)")).alias("mutated_line")),
    "golden_lines": lambda s, d: mumps.lexed_lines(_routine(s)).select("line", "label", F.array_join("formals", ",").alias("formals"), "level", F.array_join(F.transform("commands", lambda c: c["verb"]), " ").alias("verbs")),
    "golden_facts": lambda s, d: _joined(mumps.routine_facts(_routine(s)), "calls", "globals_read", "globals_written", "flags").select("lines_total", "lines_code", "lines_comment", "lines_data", "labels", "formal_labels", "calls", "globals_read", "globals_written", "naked_read", "naked_write", "max_depth", "flags", "first_comment"),
    "golden_commands": lambda s, d: mumps.routine_facts(_routine(s)).select(F.explode("commands").alias("verb", "n")),
    "golden_locals": lambda s, d: _joined(mumps.local_variables(_routine(s)), "formals", "newed", "written", "read", "unscoped").drop("name"),
    "golden_labels": lambda s, d: _joined(mumps.label_facts(_routine(s)), "formals", "own_flags", "flags", "blocked_by").drop("name"),
    "golden_naked": lambda s, d: mumps.naked_references(_routine(s)).select("line", "raw", "resolved"),
    "golden_reaching": lambda s, d: mumps.reaching_writes(mumps.variable_uses(_routine(s))).where("label = 'EN' AND variable IN ('X', 'Y')").groupBy("line", "variable").agg(F.count("*").alias("reads"), F.max("from_line").alias("from_line")),
    "golden_again": lambda s, d: mumps.reassigned_later(mumps.variable_uses(_routine(s))).where("label = 'EN'").groupBy("line", "variable").agg(F.max("again").alias("again")),
}

# The rows that each query must give.
SQL = {
    "golden_mutants": r'''SELECT * FROM (VALUES
        ('ARG_ORDER', 2, 'do_swap_0_1', 'medium', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(Y,.X):X>1 W X!Y'),
        ('ARG_ORDER', 7, 'extrinsic_swap_0_1', 'hard', false, ' Q $$F(Y,X)'),
        ('BOUNDARY', 3, 'e_index_minus1', 'easy', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,0) Q:X>2 X'),
        ('BOUNDARY', 3, 'e_index_plus1', 'easy', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,2) Q:X>2 X'),
        ('BOUNDARY', 3, 'p_range_end_minus1', 'hard', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,3),X=$E(Y,1) Q:X>2 X'),
        ('BOUNDARY', 3, 'p_range_end_plus1', 'hard', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,5),X=$E(Y,1) Q:X>2 X'),
        ('BOUNDARY', 3, 'p_range_start_minus1', 'medium', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",1,4),X=$E(Y,1) Q:X>2 X'),
        ('BOUNDARY', 3, 'p_range_start_plus1', 'medium', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",3,4),X=$E(Y,1) Q:X>2 X'),
        ('CMP_FLIP', 2, 'and_to_or', 'medium', false, 'EN(A,B) N X,Y S X=A!B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('CMP_FLIP', 2, 'ne_to_eq', 'easy', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('CMP_FLIP', 2, 'or_to_and', 'medium', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B&(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('CMP_FLIP', 2, 'pat_to_npat', 'easy', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A''?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('CMP_FLIP', 2, 'sortsafter_to_follows', 'hard', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('CMP_FLIP', 3, 'gt_to_ge', 'hard', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X''<2 X'),
        ('CMP_FLIP', 3, 'gt_to_lt', 'medium', false, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X<2 X'),
        ('CMP_FLIP', 3, 'lt_to_gt', 'medium', false, ' S X=$order(^G(A,B)) S:X>3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('CMP_FLIP', 3, 'lt_to_le', 'hard', false, ' S X=$order(^G(A,B)) S:X''>3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('CMP_FLIP', 4, 'eq_to_ne', 'easy', false, ' F  S X=$O(^G(X)) Q:X''=""  D'),
        ('DOLLAR_MISUSE', 2, 'data_to_get', 'easy', false, 'EN(A,B) N X,Y S X=A&B,Y=$G(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('DOLLAR_MISUSE', 2, 'get_drop_default', 'hard', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A) D SUB(.X,Y):X>1 W X!Y'),
        ('DOLLAR_MISUSE', 3, 'order_reverse', 'medium', false, ' S X=$order(^G(A,B),-1) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('DOLLAR_MISUSE', 4, 'order_reverse', 'medium', false, ' F  S X=$O(^G(X),-1) Q:X=""  D'),
        ('DOLLAR_MISUSE', 5, 'get_to_data', 'easy', false, ' . S Y=$D(^H(X,2)),Z=^(3)'),
        ('NAKED_REF', 4, 'introduce', 'hard', false, ' F  S X=$O(^(X)) Q:X=""  D'),
        ('NAKED_REF', 5, 'introduce', 'hard', false, ' . S Y=$G(^(2)),Z=^(3)'),
        ('NAKED_REF', 5, 'perturb_minus1', 'medium', false, ' . S Y=$G(^H(X,2)),Z=^(2)'),
        ('NAKED_REF', 5, 'perturb_plus1', 'medium', false, ' . S Y=$G(^H(X,2)),Z=^(4)'),
        ('POSTCOND', 2, 'drop_argument_level', 'hard', true, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y) W X!Y'),
        ('POSTCOND', 3, 'drop_set', 'medium', false, ' S X=$order(^G(A,B)) S Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('POSTCOND', 3, 'invert_quit', 'easy', true, ' S X=$order(^G(A,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:''(X>2) X'),
        ('POSTCOND', 3, 'invert_set', 'easy', false, ' S X=$order(^G(A,B)) S:''(X<3) Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('POSTCOND', 4, 'invert_quit', 'easy', true, ' F  S X=$O(^G(X)) Q:''(X="")  D'),
        ('STMT_DROP', 2, 'inline_do', 'medium', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) W X!Y'),
        ('STMT_DROP', 2, 'inline_set', 'hard', false, 'EN(A,B) N X,Y I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('STMT_DROP', 2, 'inline_set', 'hard', false, 'EN(A,B) N X,Y S X=A&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) D SUB(.X,Y):X>1 W X!Y'),
        ('STMT_DROP', 3, 'inline_set', 'hard', false, ' S X=$order(^G(A,B)) Q:X>2 X'),
        ('STMT_DROP', 3, 'inline_set', 'hard', false, ' S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('STMT_DROP', 5, 'line_set', 'medium', false, '(dropped)'),
        ('VAR_SWAP', 2, 'A_to_B', 'hard', false, 'EN(A,B) N X,Y S X=B&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('VAR_SWAP', 2, 'A_to_X', 'hard', false, 'EN(A,B) N X,Y S X=X&B,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('VAR_SWAP', 2, 'B_to_A', 'hard', false, 'EN(A,B) N X,Y S X=A&A,Y=$D(^G(A,1)) I X''=Y,A]]B!(A?1N.N) S X=$GET(A,5) D SUB(.X,Y):X>1 W X!Y'),
        ('VAR_SWAP', 3, 'A_to_B', 'hard', false, ' S X=$order(^G(B,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('VAR_SWAP', 3, 'A_to_X', 'hard', false, ' S X=$order(^G(X,B)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('VAR_SWAP', 3, 'B_to_A', 'hard', false, ' S X=$order(^G(A,A)) S:X<3 Y=$P(X,"^",2,4),X=$E(Y,1) Q:X>2 X'),
        ('VAR_SWAP', 4, 'X_to_A', 'hard', false, ' F  S X=$O(^G(A)) Q:X=""  D'),
        ('VAR_SWAP', 4, 'X_to_A', 'hard', false, ' F  S X=$O(^G(X)) Q:A=""  D'),
        ('VAR_SWAP', 4, 'X_to_B', 'hard', false, ' F  S X=$O(^G(B)) Q:X=""  D'),
        ('VAR_SWAP', 5, 'X_to_A', 'hard', false, ' . S Y=$G(^H(A,2)),Z=^(3)'),
        ('VAR_SWAP', 5, 'X_to_B', 'hard', false, ' . S Y=$G(^H(B,2)),Z=^(3)'),
        ('VAR_SWAP', 6, 'Y_to_A', 'hard', false, ' . S X=A'),
        ('VAR_SWAP', 6, 'Y_to_B', 'hard', false, ' . S X=B'),
        ('VAR_SWAP', 7, 'X_to_A', 'hard', false, ' Q $$F(A,Y)'),
        ('VAR_SWAP', 7, 'X_to_B', 'hard', false, ' Q $$F(B,Y)'),
        ('VAR_SWAP', 7, 'Y_to_A', 'hard', false, ' Q $$F(X,A)')
    ) t(operator, line, detail, difficulty, may_hang, mutated_line)''',
    "golden_lines": r'''SELECT * FROM (VALUES
        (1, 'RTN', CAST(NULL AS VARCHAR), 0, ''),
        (10, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 'READ SET KILL DO'),
        (11, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 'QUIT'),
        (12, 'F', 'U,V', 0, 'QUIT'),
        (2, 'EN', 'A,B', 0, 'NEW SET IF SET DO WRITE'),
        (3, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 'SET SET QUIT'),
        (4, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 'FOR SET QUIT DO'),
        (5, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 1, 'SET'),
        (6, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 1, 'SET'),
        (7, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, 'QUIT'),
        (8, 'SUB', 'P,Q', 0, ''),
        (9, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, '')
    ) t(line, label, formals, level, verbs)''',
    "golden_facts": r'''SELECT * FROM (VALUES
        (12, 11, 1, 0, 4, 3, 'OTHER', 'G,H', 'G,H', 1, 0, 2, 'read', 'first remark')
    ) t(lines_total, lines_code, lines_comment, lines_data, labels, formal_labels, calls, globals_read, globals_written, naked_read, naked_write, max_depth, flags, first_comment)''',
    "golden_commands": r'''SELECT * FROM (VALUES
        ('DO', 3),
        ('FOR', 1),
        ('IF', 1),
        ('KILL', 1),
        ('NEW', 1),
        ('QUIT', 5),
        ('READ', 1),
        ('SET', 8),
        ('WRITE', 1)
    ) t(verb, n)''',
    "golden_locals": r'''SELECT * FROM (VALUES
        ('EN', 'A,B', 'X,Y', 'X,Y,Z', 'A,B,X,Y', 'Z'),
        ('F', 'U,V', '', '', 'U,V', ''),
        ('RTN', '', '', '', '', ''),
        ('SUB', 'P,Q', '', 'P,Q', 'P,Q', '')
    ) t(label, formals, newed, written, read, unscoped)''',
    "golden_labels": r'''SELECT * FROM (VALUES
        ('EN', 1, 'A,B', 6, '', 'read', 'read', false, false),
        ('F', 3, 'U,V', 1, '', '', '', true, true),
        ('RTN', 0, CAST(NULL AS VARCHAR), 0, '', '', '', true, false),
        ('SUB', 2, 'P,Q', 2, 'read', 'read', 'read', false, false)
    ) t(label, seq, formals, lines, own_flags, flags, blocked_by, clean, reached)''',
    "golden_naked": r'''SELECT * FROM (VALUES
        (5, '^(3)', '^H(X,3)')
    ) t(line, raw, resolved)''',
    "golden_reaching": r'''SELECT * FROM (VALUES
        (2, 'X', CAST(2 AS BIGINT), 2),
        (2, 'Y', CAST(2 AS BIGINT), 2),
        (3, 'X', CAST(2 AS BIGINT), 3),
        (3, 'Y', CAST(1 AS BIGINT), 2),
        (4, 'X', CAST(1 AS BIGINT), 3),
        (5, 'X', CAST(1 AS BIGINT), 3),
        (6, 'Y', CAST(1 AS BIGINT), 2),
        (7, 'X', CAST(1 AS BIGINT), 3),
        (7, 'Y', CAST(1 AS BIGINT), 2)
    ) t(line, variable, reads, from_line)''',
    "golden_again": r'''SELECT * FROM (VALUES
        (2, 'X', true),
        (2, 'Y', true),
        (3, 'X', true),
        (3, 'Y', true),
        (4, 'X', true),
        (5, 'Y', false),
        (5, 'Z', false),
        (6, 'X', false)
    ) t(line, variable, again)''',
}
