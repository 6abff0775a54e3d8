"""Schemas of native inputs, declared once: inference would read a single child as a struct instead of an array."""

_COUNTER = "array<struct<_type:string,_missed:bigint,_covered:bigint>>"
COVERAGE_CLASS = f"_name string, _sourcefilename string, method array<struct<_name:string,_desc:string,counter:{_COUNTER}>>, counter {_COUNTER}"
_OUTCOME = "struct<_VALUE:string,_message:string,_type:string>"
TEST_SUITE = f"_name string, _tests int, _failures int, _errors int, _skipped int, _time double, testcase array<struct<_name:string,_classname:string,_time:double,failure:{_OUTCOME},error:{_OUTCOME}>>"
CONTROL_FLOW = "methods array<struct<methodSignature:string,nodes:array<struct<id:int,statements:array<string>,successors:array<int>>>>>"
CONTROL_FLOW_OLD = "methods map<string,struct<blocks:map<string,struct<head:string>>,edges:array<struct<`from`:string,`to`:string>>>>"
CLASS_STATE = "map<string,struct<status:string,last_generation:int,fitness_history:array<double>,termination_reason:string>>"
CATALOGUE_ROW = "struct<className:string,class_name:string,package:string,path:string,code:string,imports:array<string>,methods:array<string>,file_size_kb:double>"
REPORT = (
    "test_class string, target_class string, failed boolean, time_seconds double, fitness double, metrics struct<lines_covered:bigint,lines_total:bigint,branches_covered:bigint,"
    "branches_total:bigint,methods_covered:bigint,methods_total:bigint,line_coverage:double,branch_coverage:double,method_coverage:double>, covered_methods array<string>, uncovered_methods array<string>,"
    " test_summary struct<total_tests:bigint,failed_tests:bigint,passed_tests:bigint,skipped_tests:bigint>, mutation_applied boolean, mutation_type string, mutation_timestamp string, _corrupt_record string"
)
