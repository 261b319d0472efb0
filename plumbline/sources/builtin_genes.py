"""Built-in clinical genes, used where no gene table is given."""

# Public GENCODE v44 gene coordinates on hg38, 0-based half-open, tab-separated:
# name, contig, start, end, strand, gene id, gene type.
BUILTIN_GENES = """
BRCA1	chr17	43044294	43125482	-	ENSG00000012048	protein_coding
BRCA2	chr13	32315085	32400268	+	ENSG00000139618	protein_coding
PALB2	chr16	23603159	23641310	-	ENSG00000083093	protein_coding
BRIP1	chr17	61679185	61863558	-	ENSG00000136492	protein_coding
RAD51C	chr17	58692572	58735610	-	ENSG00000108384	protein_coding
RAD51D	chr17	35100868	35120783	+	ENSG00000185379	protein_coding
ATM	chr11	108222484	108369102	+	ENSG00000149311	protein_coding
CHEK2	chr22	28687743	28742422	-	ENSG00000183765	protein_coding
CDH1	chr16	68737225	68835541	+	ENSG00000039068	protein_coding
TP53	chr17	7668401	7687550	-	ENSG00000141510	protein_coding
PTEN	chr10	87862624	87971930	+	ENSG00000171862	protein_coding
RB1	chr13	48303747	48481890	+	ENSG00000139687	protein_coding
APC	chr5	112707497	112846239	+	ENSG00000134982	protein_coding
VHL	chr3	10141727	10153668	+	ENSG00000134086	protein_coding
NF1	chr17	31094927	31377677	+	ENSG00000196712	protein_coding
NF2	chr22	29603556	29698600	+	ENSG00000186575	protein_coding
WT1	chr11	32389063	32435260	-	ENSG00000184937	protein_coding
CDKN2A	chr9	21967750	21995324	-	ENSG00000147889	protein_coding
STK11	chr19	1205797	1228431	+	ENSG00000118046	protein_coding
SMAD4	chr18	51028393	51085042	+	ENSG00000141646	protein_coding
BAP1	chr3	52401101	52411753	-	ENSG00000163930	protein_coding
MUTYH	chr1	45329162	45340399	-	ENSG00000132781	protein_coding
EGFR	chr7	55019016	55211628	+	ENSG00000146648	protein_coding
KRAS	chr12	25204788	25250936	-	ENSG00000133703	protein_coding
NRAS	chr1	114704463	114716894	-	ENSG00000213281	protein_coding
BRAF	chr7	140719326	140924929	-	ENSG00000157764	protein_coding
PIK3CA	chr3	179148113	179240093	+	ENSG00000121879	protein_coding
ERBB2	chr17	39687913	39730426	+	ENSG00000141736	protein_coding
MET	chr7	116672195	116798386	+	ENSG00000105976	protein_coding
ALK	chr2	29192773	29921566	-	ENSG00000171094	protein_coding
ROS1	chr6	117288198	117425855	-	ENSG00000047936	protein_coding
RET	chr10	43077027	43130351	+	ENSG00000165731	protein_coding
KIT	chr4	54657927	54740715	+	ENSG00000157404	protein_coding
PDGFRA	chr4	54229096	54298245	+	ENSG00000134853	protein_coding
AKT1	chr14	104769349	104795743	-	ENSG00000142208	protein_coding
CDK4	chr12	57747727	57752330	-	ENSG00000135446	protein_coding
MLH1	chr3	36993349	37050846	+	ENSG00000076242	protein_coding
MSH2	chr2	47403067	47709830	+	ENSG00000095002	protein_coding
MSH6	chr2	47695530	47721031	+	ENSG00000116062	protein_coding
PMS2	chr7	5970924	6009019	-	ENSG00000122512	protein_coding
EPCAM	chr2	47345277	47387687	+	ENSG00000119888	protein_coding
MYBPC3	chr11	47331268	47352957	-	ENSG00000134571	protein_coding
MYH7	chr14	23412739	23435444	-	ENSG00000092054	protein_coding
TNNT2	chr1	201328135	201346803	-	ENSG00000118194	protein_coding
LMNA	chr1	156082573	156109880	+	ENSG00000160789	protein_coding
SCN5A	chr3	38548061	38649670	+	ENSG00000183873	protein_coding
KCNQ1	chr11	2444707	2849109	-	ENSG00000053918	protein_coding
KCNH2	chr7	150642042	150675403	-	ENSG00000055118	protein_coding
CFTR	chr7	117479963	117668665	+	ENSG00000001626	protein_coding
HBB	chr11	5225464	5227071	-	ENSG00000244734	protein_coding
HEXA	chr15	72345371	72380305	-	ENSG00000213614	protein_coding
GBA1	chr1	155234452	155244699	-	ENSG00000177628	protein_coding
FMR1	chrX	147911919	147951125	-	ENSG00000102081	protein_coding
SMN1	chr5	70924941	70953015	+	ENSG00000172062	protein_coding
CYP2D6	chr22	42126498	42130881	-	ENSG00000100197	protein_coding
CYP2C19	chr10	94762680	94855547	+	ENSG00000165841	protein_coding
DPYD	chr1	97543299	98386615	-	ENSG00000188641	protein_coding
TPMT	chr6	18128542	18155374	+	ENSG00000137364	protein_coding
UGT1A1	chr2	233757808	233773299	-	ENSG00000241635	protein_coding
MYC	chr8	127735433	127742951	+	ENSG00000136997	protein_coding
FGFR1	chr8	38411138	38468834	+	ENSG00000077782	protein_coding
FGFR2	chr10	121478332	121598458	-	ENSG00000066468	protein_coding
FGFR3	chr4	1793293	1808872	+	ENSG00000068078	protein_coding
IDH1	chr2	208236227	208255071	-	ENSG00000138413	protein_coding
IDH2	chr15	90083040	90102468	-	ENSG00000182054	protein_coding
JAK2	chr9	4984390	5129948	+	ENSG00000096968	protein_coding
"""

# Common aliases.
BUILTIN_ALIASES = {
    "HER2": "ERBB2",
    "HER-2": "ERBB2",
    "NEU": "ERBB2",
    "P53": "TP53",
    "GBA": "GBA1",
}
