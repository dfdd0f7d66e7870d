"""Row types of the posting tables and of landed payloads."""

from __future__ import annotations

JD = "struct<citizenship:boolean,sponsorship:boolean,qualifications:array<string>,country:string,location:string,category:string,season:string>"
JOB = f"id bigint, company string, role string, link string, location string, jd {JD}"
OPPORTUNITY = f"{JOB}, postedAt string"
COMPANY = "name string, ats string, identifier string, domain string, page string, urls array<string>"
SOURCE = "name string, url string, format string, type string, disabled boolean"
#: What a fetcher lands: the engine itself opens no connection.
LANDED = "url string, fetched_at timestamp, code int, `desc` string, body string"

#: Vendors' list payloads, by the field names of their interfaces (fixed values).
PAYLOADS = {
    "greenhouse": "jobs array<struct<company_name:string,title:string,absolute_url:string,first_published:string,updated_at:string,location:struct<name:string>>>",
    "lever": "array<struct<company_name:string,text:string,hostedUrl:string,createdAt:bigint,categories:struct<location:string>>>",
    "workday": "jobPostings array<struct<title:string,postedOn:string,locationsText:string,externalPath:string>>",
    "ashby": "jobs array<struct<id:string,title:string,location:string,jobUrl:string,publishedAt:string>>",
    "smartrecruiters": "content array<struct<id:string,name:string,company:struct<name:string>,releasedDate:string,location:struct<fullLocation:string>>>",
    "oraclecloud": "items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string>>>>",
    "amazon": "searchHits array<struct<fields:struct<title:array<string>,url:string,location:array<string>,createdDate:array<bigint>,updatedDate:array<bigint>,icimsJobId:array<string>>>>",
    "microsoft": "data struct<positions:array<struct<name:string,url:string,location:array<string>,creationTs:bigint,postedTs:bigint>>>",
    "netflix": "positions array<struct<id:string,posting_name:string,location:string,canonicalPositionUrl:string>>",
    "tiktok": "code int, data struct<total:int,job_post_list:array<struct<id:string,title:string,city_info:struct<en_name:string,name:string>>>>",
    "amd": "jobs array<struct<data:struct<req_id:string,title:string,full_location:string,short_location:string,location_name:string,city:string,state:string,country:string,posted_date:string>>>",
    "meta": "data struct<job_search_with_featured_jobs:struct<all_jobs:array<struct<id:string,title:string,locations:array<string>>>>>",
}
