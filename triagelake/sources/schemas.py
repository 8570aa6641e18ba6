"""Declared schemas: the superset of fields of each record set, all nullable. Contact fields are left out on purpose."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()  # noqa: E741
A = T.ArrayType(S)
#: Fields that come as numbers, as text or as flags: kept as they are, so that each value is read by its own type.
V = T.VariantType()


def _schema(text: str = "", **kinds: tuple[T.DataType, str]) -> T.StructType:
    fields = [T.StructField(n, S) for n in text.split()]
    for kind, names in kinds.values():
        fields += [T.StructField(n, kind) for n in names.split()]
    return T.StructType(fields)


OPPORTUNITIES = _schema(
    "bidNtceNo bidNtceOrd bidNtceNm ntceInsttNm dminsttNm bidMethdNm cntrctCnclsMthdNm bidBeginDt bidClseDt opengDt ntceSpecDocUrl1 "
    "ntceSpecDocUrl2 ntceSpecDocUrl3 ntceSpecFileNm1 ntceSpecFileNm2 ntceSpecFileNm3 sourceType sourceUrl title agency noticeAgency demandAgency contractMethod "
    "noticeNo publishedDate postedDate noticeDate deadline deadlineDate opportunityStatus projectScale grade category categoryLabel fitReason "
    "recommendedAction scoringVersion bidNtceEndDt bidNtceDt bidNtceBgnDt bidNtceBgn bidClseDate",
    mixed=(V, "score daysLeft budgetAmount asignBdgtAmt presmptPrce"),
    lists=(A, "matchedKeywords matchedCategories directFitKeywords supportFitKeywords hardExcludeKeywords scoreReasons"),
)
AGENCIES = _schema(
    "agencyName agencyType region grade note recommendedProposal nextAction",
    mixed=(V, "estimatedAmount relatedCount bidCount contractCount awardCount orderPlanCount"), lists=(A, "mainKeywords"),
    rows=(T.ArrayType(_schema("sourceUrl sourceType title amount date")), "evidenceSources"),
)
ART = _schema(
    "id category categoryLabel status title agency organization region regionGroup regionGroupLabel source sourceName sourceType sourceUrl originalUrl url "
    "rawSourcePageUrl publishedDate postedDate deadline endDate deadlineSource crawlMode priorityLabel grade fitReason summary nextAction rawText "
    "collectedAt updatedAt detailFetchStatus detailDeadlineKeyword detailTextSample deadlineStatus periodStart periodEnd publishedDateSource periodSource "
    "periodKeyword deadlineKeyword dateConfidence dateNormalizationVersion dateNormalizedAt noticeDate createdDate closeDate recommendedAction bidNtceNo",
    mixed=(V, "budget amount priority priorityScore candidateAgeDays"), flags=(B, "isExpired isStaleCandidate"), lists=(A, "keywords matchedKeywords"),
)
LOCAL = _schema(
    "title sourceName agencyName noticeAgency demandAgency department contractMethod noticeNo sourceId opportunityStatus projectScale projectType type category "
    "region grade deadline endDate closeDate openingDate deadlineAndOpening sourceUrl sourcePageUrl rawSourcePageUrl attachmentUrl fitReason reason nextAction",
    mixed=(V, "score budget"), lists=(A, "directFitKeywords supportFitKeywords keywords"),
)
META = _schema(
    "lastUpdatedAt timezone",
    whole=(I, "opportunityCount agencyCount artCommissionCount localProjectCount importantOpportunityCount importantAgencyCount newArtCommissionCount"),
)
PRIORITY = _schema(
    "id bidNtceNo noticeNo noticeId sourceId title bidNtceNm projectName agency organization ntceInsttNm dminsttNm noticeAgency demandAgency priorityCategory "
    "priorityCategoryLabel category categoryKey categoryLabel field sourceType source sourceName grade gradeReason fitReason summary nextAction recommendedAction "
    "publishedDate postedDate startDate bidNtceDt deadline endDate bidNtceEndDt bidClseDt deadlineDate closeDate sourceUrl originalUrl url ntceSpecDocUrl1 "
    "documentUrl",
    mixed=(V, "score fitScore priorityScore amount budget supportAmount budgetAmount asignBdgtAmt presmptPrce"), flags=(B, "isExcludedFromPriority"), lists=(A, "matchedPriorityKeywords matchedKeywords keywords"),
)
TARGETS = _schema("priority priorityLabel regionGroup regionGroupLabel region sourceName sourceUrl crawlStrategyLabel crawlMode recommendedAction", flags=(B, "enabled"))
APPLICATIONS = _schema("id researchId title institution status priority owner deadline internalDeadline nextAction nextActionDue sourceUrl driveUrl", whole=(I, "progress"))
REGISTERED = _schema("projectId status statusLabel sheetUpdatedAt syncedAt updatedAt", flags=(B, "registered"), whole=(I, "progress"))
#: Names of the fields that any of these keeps as VARIANT.
MIXED = frozenset(f.name for schema in (OPPORTUNITIES, AGENCIES, ART, LOCAL, PRIORITY) for f in schema.fields if f.dataType == V)
