"""The catalog of rules, and the profiles that select from it.

A rule has a number, a name, a group, a clause and a subclause. `live` rules are evaluated; the others are in the catalog alone.
`repair` names the operator that mends what a rule finds, if there is one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: By group: name, clause, subclause, and the repair after a slash; a name in parentheses isn't live.
_TEXT = {
    "Structure": """
        FileHeaderSignature 6.1.2 1
        FileHeaderComment 6.1.2 2
        FileHeaderCommentLength 6.1.2 3
        FileHeaderCommentBytes 6.1.2 4
        TrailerID 6.1.3 1
        TrailerEncrypt 6.1.3 2
        TrailerEOF 6.1.3 3
        XRefKeyword 6.1.4 1
        XRefSubsectionHeader 6.1.4 2
        XRefSubsectionHeaderFormat 6.1.4 3
        XRefStream 6.1.4 4
        InfoDictUnreadable 6.1.5 1
        InfoDictEmptyValues 6.1.5 2
        InfoDictXMPMismatch 6.1.5 3
        GraphResolutionFailure 6.1.6 0
        HexStringInvalidChar 6.1.6 1 / contentLimitsFixer
        HexStringOddLength 6.1.6 2 / contentLimitsFixer
        StreamFileSpec 6.1.7 1 / fileSpecFixer
        StreamFileFilter 6.1.7 2 / fileSpecFixer
        StreamFileDecodeParams 6.1.7 3 / fileSpecFixer
        StreamKeywordEOL 6.1.7 4
        EndstreamEOL 6.1.7 5
        StreamLengthIncludesEOL 6.1.7 6
        StreamLengthMismatch 6.1.7 7
        ObjectFraming 6.1.8 1
        StreamLZWFilter 6.1.10 1 / lzwStreamFixer
        InlineImageLZWFilter 6.1.10 2 / inlineImageLZWFixer
        EmbeddedFileSpec 6.1.11 1 / fileSpecFixer
        EmbeddedFiles 6.1.11 2 / fileSpecFixer
        NameTooLong 6.1.12 1 / nameTooLongFixer
        IntegerOutOfRange 6.1.12 2 / contentLimitsFixer
        RealOutOfRange 6.1.12 8 / contentLimitsFixer
        ArrayTooLarge 6.1.12 3 / pagesTreeArrayFixer
        DictTooLarge 6.1.12 4 / resourceDictPruneFixer
        CMapCIDOutOfRange 6.1.12 5 / cmapCIDClampFixer
        StringTooLong 6.1.12 6 / contentLimitsFixer
        DeviceNColorants 6.1.12 7 / deviceNColorantsFixer
        IndirectObjectsExceeded 6.1.12 9
        GraphicsStateNesting 6.1.12 10 / contentLimitsFixer
        OptionalContent 6.1.13 1 / optionalContentFixer
        PostPDF14ViewerPref 6.1.2 5 / viewerPrefFixer
    """,
    "Colour": """
        OutputIntentNotArray 6.2.2 1
        OutputIntentNotDict 6.2.2 2
        OutputIntentInvalidS 6.2.2 3
        OutputIntentWrongS 6.2.2 4
        OutputIntentMissingIdentifier 6.2.2 5
        OutputIntentMultipleProfiles 6.2.2 6
        OutputIntentUnresolvedProfile 6.2.2 7
        OutputIntentInvalidProfile 6.2.2 8
        OutputIntentMissingN 6.2.2 9
        OutputIntentInvalidN 6.2.2 10
        OutputIntentICCVersion 6.2.2 11
        ICCBasedComponentsMismatch 6.2.3.2 1
        DeviceColourSpaceUsage 6.2.3.3 1 / deviceColourFixer
        DeviceColourContentStream 6.2.3.3 2 / deviceColourFixer
        SeparationAlternateColour 6.2.3.4 1
        RenderingIntent 6.2.9 1 / contentLimitsFixer
        UndefinedOperator 6.2.10 1 / contentLimitsFixer
    """,
    "Image": """
        ImageInterpolate 6.2.4 1 / imageMetadataFixer
        ImageAlternates 6.2.4 2 / imageMetadataFixer
        ImageOPI 6.2.4 3 / imageMetadataFixer
        ImageRenderingIntent 6.2.4 4 / imageMetadataFixer
        ImageBitsPerComponent 6.2.4 5
        ImageMaskBitsPerComponent 6.2.4 6
        FormOPI 6.2.5 1 / imageMetadataFixer
        FormSubtype2PS 6.2.5 2 / postScriptXObjectFixer
        FormPSEntry 6.2.5 3 / postScriptXObjectFixer
        ReferenceXObject 6.2.6 1 / imageMetadataFixer
        FormPostScript 6.2.7 1 / postScriptXObjectFixer
        PostScriptXObject 6.2.7 2
    """,
    "Transparency": """
        TransferFunction 6.2.8 1 / extGStateFixer
        DefaultTransferFunction 6.2.8 2 / extGStateFixer
        ExtGStateRenderingIntent 6.2.8 3 / extGStateFixer
        SoftMaskExtGState 6.4 1 / extGStateFixer
        BlendMode 6.4 2 / extGStateFixer
        StrokingAlpha 6.4 3 / extGStateFixer
        NonStrokingAlpha 6.4 4 / extGStateFixer
        TransparencyGroup 6.4 5 / transparencyFlattener
        ImageWithSoftMask 6.4 6 / transparencyFlattener
    """,
    "Font": """
        (FontType) 6.3.2 1
        InvalidSubtype 6.3.2 2
        FontBaseFont 6.3.2 3
        (SimpleFontFirstChar) 6.3.2 4
        (SimpleFontLastChar) 6.3.2 5
        (SimpleFontWidths) 6.3.2 6
        (FontFileSubtype) 6.3.2 7
        InvalidProgram 6.3.2 8 / fontSubstitutionFixer
        CIDSystemInfoMismatch 6.3.3.1 1 / type0FontFixer
        CIDToGIDMapMissing 6.3.3.2 1 / fontDictFixer
        CMapNotEmbedded 6.3.3.3 1
        CMapWModeInconsistent 6.3.3.3 2 / type0FontFixer
        SimpleNotEmbedded 6.3.4 1 / fontSubstitutionFixer
        CIDNotEmbedded 6.3.4 2 / fontSubstitutionFixer
        SubsetGlyphCoverage 6.3.5 1 / fontSubstitutionFixer
        Type1SubsetCharSet 6.3.5 2 / fontSubsetMetaFixer
        CIDSubsetCIDSet 6.3.5 3 / fontSubsetMetaFixer
        AdvanceWidthMismatch 6.3.6 1 / fontMetricFixer
        TrueTypeEncoding 6.3.7 1 / trueTypeEncodingFixer
        SymbolicTrueTypeEncoding 6.3.7 2 / trueTypeEncodingFixer
        SymbolicTrueTypeCmap 6.3.7 3 / trueTypeEncodingFixer
        (ToUnicodeMissing) 6.3.8 1
    """,
    "LogicalStructure": """
        (TaggedMarkInfo) 6.8.2.2 1
        (StructTreeRoot) 6.8.3.3 1
        (RoleMapStandardType) 6.8.3.4 1
        (RoleMapCircular) 6.8.3.4 2
        (LangIdentifier) 6.8.4 1
    """,
    "Annotation": """
        DisallowedSubtype 6.5.2 1 / disallowedAnnotFixer
        PrintFlagNotSet 6.5.3 1 / annotationFlagsFixer
        HiddenFlagSet 6.5.3 2 / annotationFlagsFixer
        InvisibleFlagSet 6.5.3 3 / annotationFlagsFixer
        NoViewFlagSet 6.5.3 4 / annotationFlagsFixer
        OpacityNotOne 6.5.3 5 / annotationFlagsFixer
        MissingAppearance 6.5.3 6 / appearanceFixer
        AppearanceMissingN 6.5.3 7 / appearanceFixer
        AppearanceExtraEntries 6.5.3 8 / appearanceFixer
        AppearanceNNotStream 6.5.3 9 / appearanceFixer
        ColourWithoutIntent 6.5.3 10 / annotColourFixer
    """,
    "Action": """
        ForbiddenActionType 6.6.1 1 / actionFixer
        DisallowedNamedAction 6.6.1 2 / actionFixer
        AdditionalActions 6.6.2 1 / actionFixer
    """,
    "Metadata": """
        MetadataMissing 6.7.2 1
        MetadataFiltered 6.7.2 2
        MetadataPropertyType 6.7.2 3
        MetadataUndeclaredProperty 6.7.2 4
        InfoXMPSync 6.7.3 1
        XPacketBytesAttribute 6.7.5 1
        XPacketEncodingAttribute 6.7.5 2
        ObjectXMPNoXPacket 6.7.5 3
        ExtSchemaNamespace 6.7.8 1
        ExtSchemaWrongPrefixURI 6.7.8 2
        ExtSchemasNotBag 6.7.8 3
        ExtPropertyMultipleName 6.7.8 4
        ExtPropertyMissingField 6.7.8 5
        ExtPropertyComplexAsSimple 6.7.8 6
        ExtTypeInvalid 6.7.8 7
        ExtFieldInvalid 6.7.8 8
        ExtPropertyUndocumented 6.7.8 9
        ExtPropertyUndefinedType 6.7.8 10
        XMPStreamUnreadable 6.7.9 1
        XMPNotWellFormed 6.7.9 2
        (XMPNoCorrespondingType) 6.7.9 3
        PDFAIdentifierMissing 6.7.11 1
        PDFAIdentifierNamespace 6.7.11 2
        PDFAConformanceLevel 6.7.11 3
        PDFAPartNumber 6.7.11 4
        PDFAIdentifierUndefinedProperty 6.7.11 5
    """,
    "Form": """
        NeedAppearances 6.9 1 / formFixer
        XFA 6.9 2 / formFixer
        FieldAction 6.9 3 / formFixer
        FieldAdditionalActions 6.9 4 / formFixer
        WidgetMissingAppearance 6.9 5 / appearanceFixer
    """,
    "ObjectModel": """
        MissingRequiredKey objmodel 1 / missingRequiredKeyFixer
        WrongValueType objmodel 2 / wrongValueTypeFixer
        DisallowedValue objmodel 3 / disallowedValueFixer
        IndirectRequired objmodel 4 / indirectRequiredFixer
        KeyIntroducedAfterPDF14 objmodel 5 / post14KeyFixer
        ConstraintViolated objmodel 6 / constraintFixer
    """,
}


@dataclass(frozen=True)
class Check:
    check_id: int
    group: str
    name: str
    clause: str
    subclause: int
    live: bool
    repair: str | None

    @property
    def description(self) -> str:
        return re.sub(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[A-Z][a-z])", " ", self.name).lower()


@cache
def all_checks() -> tuple[Check, ...]:
    """Every rule, in catalog order; check_id counts from 1."""
    out = []
    for group, text in _TEXT.items():
        for line in filter(None, map(str.strip, text.splitlines())):
            rule, _, repair = line.partition(" / ")
            name, clause, sub = rule.split()
            out.append(Check(len(out) + 1, group, name.strip("()"), clause, int(sub), name[0] != "(", repair or None))
    return tuple(out)


@cache
def _by_name() -> dict[str, Check]:
    return {c.name: c for c in all_checks()}


def check_by_name(name: str) -> Check | None:
    return _by_name().get(name)


def check_by_clause(clause: str, subclause: int) -> Check | None:
    return next((c for c in all_checks() if (c.clause, c.subclause) == (clause, subclause)), None)


def checks_for_clause(clause: str) -> list[Check]:
    return [c for c in all_checks() if c.clause == clause]


def clause_key(clause: str) -> tuple:
    """For the natural order of clauses: numbers as numbers, other parts after them as text."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in clause.split("."))


@dataclass(frozen=True)
class Profile:
    """A set of rules and two flags; changes give a new profile."""

    name: str = "custom"
    enabled: frozenset[int] = field(default_factory=frozenset)
    skip_unreachable_forms: bool = False
    skip_unused_simple_fonts: bool = False

    def add(self, *names: str) -> Profile:
        return replace(self, enabled=self.enabled | {_by_name()[n].check_id for n in names})

    def remove(self, *names: str) -> Profile:
        return replace(self, enabled=self.enabled - {_by_name()[n].check_id for n in names})

    def clear(self) -> Profile:
        return replace(self, enabled=frozenset())

    def has(self, name: str) -> bool:
        return (c := check_by_name(name)) is not None and c.check_id in self.enabled

    def checks(self) -> list[Check]:
        return [c for c in all_checks() if c.check_id in self.enabled]

    def allows(self, clause: str, subclause: int) -> bool:
        """A clause that the catalog lacks passes."""
        c = check_by_clause(clause, subclause)
        return c is None or c.check_id in self.enabled

    def only_object_model(self) -> bool:
        return bool(self.enabled) and all(c.group == "ObjectModel" for c in self.checks())


def full_profile(name: str = "full") -> Profile:
    return Profile(name, frozenset(c.check_id for c in all_checks()))


def object_model_profile() -> Profile:
    return Profile("pdf").add(*[c.name for c in all_checks() if c.group == "ObjectModel"])


@cache
def profiles() -> dict[str, Profile]:
    """pdf: the object model alone; strict_1b: all rules; a_1b: the lenient reading of the archival profile."""
    lenient = replace(full_profile("a_1b"), skip_unreachable_forms=True, skip_unused_simple_fonts=True)
    return {"pdf": object_model_profile(), "strict_1b": full_profile("strict_1b"), "a_1b": lenient.remove("FormPostScript", "PostScriptXObject", "KeyIntroducedAfterPDF14")}


CHECKS_SCHEMA = "check_id int, check_group string, name string, description string, clause string, subclause int, live boolean, repair string"


def checks_frame(spark: SparkSession) -> DataFrame:
    """The catalog as a table of a row a rule."""
    rows = [(c.check_id, c.group, c.name, c.description, c.clause, c.subclause, c.live, c.repair) for c in all_checks()]
    return spark.createDataFrame(rows, CHECKS_SCHEMA)


def profile_frame(spark: SparkSession, *chosen: Profile) -> DataFrame:
    """profile, check_id of the rules that each profile enables."""
    rows = [(p.name, c) for p in chosen or profiles().values() for c in sorted(p.enabled)]
    return spark.createDataFrame(rows, "profile string, check_id int")
